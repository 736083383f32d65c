"""Token counts without token ids: pieces of a distinct pre-token times its frequency.

A text's pre-tokens are found by the vocabulary's own splitting pattern.  Distinct pre-tokens of a
run of documents are counted once by the tokenizer library and kept in the worker's table; each
document's pre-token frequencies are joined to that table and summed.  The table lives as long as
the worker does, over slices and tasks, and is emptied at ``MEMO`` entries, so its size is bounded;
emptying it costs a recount and never a result.

The join stays inside the task on purpose: words that are new to the vocabulary make more
(document, pre-token) rows than bytes of input would justify sending over the network.

Defined results: null and empty texts have 0 bytes and 0 tokens; very long texts are handled as one
list of pre-tokens; repeated rows give repeated results; further columns are ignored.  The literal
text of a special token counts as that one token, as the library does by default.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from orrery.llm import bytesops as B
from orrery.llm.common import arrow_map, table, texts

MEMO = 300_000
LIMIT = 1024
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Code points from here on may be of another class in the library's Unicode tables than in Python's.
_LATE = re.compile("[՘-\U0010ffff]")

_COUNTERS: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts the tokens of texts for one tokenizer file."""

    def __init__(self, path: str):
        import json

        import regex
        from tokenizers import Tokenizer

        import public_tokenizers

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = [x["content"] for x in json.load(f).get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.assigned: dict[str, bool] = {}
        self.memo: dict[str, int] = {}

    def _doubtful(self, text: str) -> bool:
        """The text has code points on whose class Unicode versions differ."""
        known = self.assigned
        for c in set(text):
            if c not in known:
                known[c] = unicodedata.category(c) != "Cn"
            if not known[c]:
                return True
        return False

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """(pre-tokens, number of special tokens)."""
        n = 0
        if self.special is not None and self.special.search(text):
            n = len(self.special.findall(text))
            parts = self.special.split(text)
        else:
            parts = (text,)
        out: list[str] = []
        for p in parts:
            if _LATE.search(p) and self._doubtful(p):
                out += [p[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(p)]
            else:
                out += self.split(p)
        return out, n

    def counts(self, docs: list[str]) -> list[int]:
        freqs, extra = [], []
        for t in docs:
            pre, n = self.pretokens(t)
            freqs.append(Counter(pre))
            extra.append(n)
        new = set().union(*freqs) if freqs else set()
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = [w for w in new if w not in self.memo]
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            self.memo.update(zip(part, (len(e.ids) for e in self.tok.encode_batch(part, add_special_tokens=False))))
        memo = self.memo
        return [n + sum([memo[w] * k for w, k in f.items()]) for f, n in zip(freqs, extra)]


def _counter(path: str) -> PieceCounter:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task uses its own core
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def _run(path: str, limit: int):
    def run(batches):
        counter = _counter(path)
        for batch in batches:
            for part, _, offs in B.slices(batch):
                n = np.array(counter.counts(B.column(part, "text").to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([B.column(part, "doc_id"), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = LIMIT) -> DataFrame:
    """doc_id, UTF-8 bytes, tokens, and whether there are more than ``limit``."""
    return arrow_map(texts(docs), _run(tokenizer, limit), SCHEMA)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
