"""Token counts by a whole-token shortcut."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tieweave.llm.common import WordCache, kept, read, with_columns_of_text

#: Where a text can be cut: before a space behind something that isn't white space, nor the sign that stands for a space in sentencepiece.
CUT = re.compile(r"(?<=[^\s▁])(?= )")


class JsonCounter:
    """Counts of pieces by a BPE file of the tokenizers library.

    A piece is parted into pre-tokens by the file's own normaliser and pre-tokeniser. A pre-token in `whole` is one token; the others are merged. A piece
    that holds one of the added tokens goes to the library as it is.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.all = Tokenizer.from_file(path)
        self.all.no_truncation()
        self.all.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE":
            raise ValueError("counts are made for BPE models")
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.normalize = self.all.normalizer.normalize_str if self.all.normalizer else str
        self.split, self.merge = self.all.pre_tokenizer.pre_tokenize_str, self.all.model.tokenize
        # Spaces only part words: the file drops them, and no merge crosses one.
        self.drops_spaces = not self.split(self.normalize(" ")) and [s for s, _ in self.split(self.normalize("a b"))] == ["a", "b"]
        self.whole: frozenset[str] = frozenset()

    def proven(self) -> frozenset[str]:
        """The vocabulary's strings, as pre-tokens, that the merges turn into one token."""
        strings = (v.removesuffix(self.end) for v in self.all.get_vocab(with_added_tokens=False) if v.endswith(self.end))
        return frozenset(s for s in strings if s and len(self.merge(s)) == 1)

    def count(self, piece: str) -> int:
        if any(a in piece for a in self.added):
            return len(self.all.encode(piece, add_special_tokens=False).ids)
        return sum(1 if s in self.whole else len(self.merge(s)) for s, _ in self.split(self.normalize(piece)))

    def pieces(self, text: str) -> list[str]:
        return CUT.split(text)


class ModelCounter:
    """Counts of pieces by a sentencepiece file whose vocabulary has no string with a space behind another character, so that no merge crosses one."""

    drops_spaces = False

    def __init__(self, path: str):
        import sentencepiece

        self.all = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.all.id_to_piece(i) for i in range(self.all.get_piece_size())]
        self.names = [n for i, n in enumerate(names) if not (self.all.is_control(i) or self.all.is_unknown(i) or self.all.is_byte(i))]
        plain = self.all.encode("  a  b ", out_type=str)
        self.cuts = "".join(plain) == "▁▁▁a▁▁b▁" and not any("▁" in n.lstrip("▁") for n in self.names)
        self.space = len(self.all.encode("a ")) - len(self.all.encode("a"))
        self.whole: frozenset[str] = frozenset()

    def proven(self) -> frozenset[str]:
        """The vocabulary's strings, with their space before them, that encode as one token where they are a piece behind another one."""
        strings = [n.replace("▁", " ") for n in self.names if n.startswith("▁") and len(n) > 1] if self.cuts else []
        return frozenset(s for s, ids in zip(strings, self.all.encode([s[1:] for s in strings]), strict=True) if len(ids) == 1)

    def count(self, piece: str) -> int:
        if piece == " ":  # the library has no tokens for an empty text
            return self.space
        return 1 if piece in self.whole else len(self.all.encode(piece[1:]))

    def pieces(self, text: str) -> list[str]:
        """The first one has the space in front that the library puts there."""
        if not text:
            return []
        return CUT.split(" " + text) if self.cuts else [" " + text]


def counter(path: str):
    return (ModelCounter if path.endswith(".model") else JsonCounter)(path)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 2048, most_pieces: int = 300_000) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens (without begin, end or added tokens) and over_limit (more than `limit` tokens).

    tokenizer: the path, on the driver and all executors, of a BPE file of tokenizers (.json) or sentencepiece (.model). Which strings of the vocabulary are one
    token by themselves is proven once, on the driver, and broadcast: it is bounded by the vocabulary. Texts are cut where no token can cross; each
    different piece of a batch is counted once, a whole token as one, any other by merging it. At most most_pieces counts are held by a worker.
    Null and empty texts have no bytes and no tokens; repeated rows are counted alike; an empty table stays empty; columns named like the new ones are
    replaced. Special strings in texts count as the library reads them by default; nothing is cut off or padded.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    shared = docs.sparkSession.sparkContext.broadcast(counter(tokenizer).proven())

    def make() -> Callable:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"

        def load():
            own = counter(tokenizer)
            own.whole = shared.value
            return own, WordCache(lambda pieces: [own.count(p) for p in pieces], most=most_pieces)

        own, cache = kept(f"counts of {tokenizer}", load)

        def work(texts: pa.Array) -> list:
            texts = pc.fill_null(texts, "")
            if own.drops_spaces:
                split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
                coded, starts = pc.dictionary_encode(split.flatten()), split.offsets.to_numpy()
            else:
                cut = [own.pieces(t) for t in texts.to_pylist()]
                coded = pc.dictionary_encode(pa.array(chain.from_iterable(cut), pa.string()))
                starts = np.cumsum([0, *map(len, cut)])
            pieces = coded.dictionary.to_pylist()
            cache.learn(pieces)
            n = np.fromiter((cache[p] for p in pieces), np.int64, len(pieces))
            before = np.concatenate([[0], np.cumsum(n[coded.indices.to_numpy(zero_copy_only=False)])])
            tokens = np.diff(before[starts])
            return [pc.binary_length(texts).cast(pa.int64()), tokens, tokens > limit]

        return work

    fields = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return with_columns_of_text(docs, fields, make, arrow=True)


def op13_token_counts(spark, sf_dir: str) -> DataFrame:
    """Every document with its bytes, its tokens by word_bpe_49k.json and whether these are over 2,048."""
    return count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
