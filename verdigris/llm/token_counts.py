"""Token counts by prefix dynamic programming.

For every prefix of a text (in characters) the exact token count is known from
the count at the start of its last word and the count of that word's prefix:
count(text[:c]) = count(text[:start]) + inside(word[:c - start]). The table of
a text keeps the differences of consecutive prefixes, one byte each, so its
running sum answers any truncation or budget question without encoding again.
Inside a word, prefixes up to LONG characters are encoded by the library once
per distinct word; a longer run is solved by a second recurrence over its
prefixes: the last token of a prefix is the one that the merges leave unchanged
beside the last token of what stands before it.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import KEPT, LONG, Encoder, Lookup, byte_letters, core_of, default_vocabulary, encoder, folded, split_words, text_list

#: First byte of a table. A word's own narrow table has none: no difference of a first prefix is as low as the mark of wide ones.
NARROW, WIDE = b"\x01", b"\x80"


class PrefixCounter:
    """Tables of texts for one vocabulary."""

    def __init__(self, enc: Encoder):
        self.enc = enc
        if enc.by_word:
            self.core_prefixes = Lookup(self._count, {})
            self.cores = Lookup(self._core, {})
            self.words = Lookup(self._word, {})
            self.ones = {m: bytes([len(x) // enc.dtype.itemsize]) for m, x in enc.marks.items() if m} | {"": b""}
        self.wide = False
        self.merges = None

    def _count(self, prefix: str) -> int:
        return len(self.enc.merge(byte_letters(prefix)))

    def _core(self, letters: str) -> bytes:
        """Table of plain letters; the library counts each distinct prefix."""
        known = self.core_prefixes
        return steps_of([known[letters[:j]] for j in range(1, len(letters) + 1)])

    def _word(self, word: str) -> bytes:
        if len(word) > LONG:
            out = steps_of(self.long_counts(word) if self.plain(word) else self.few_counts(word))
            self.wide |= out[:1] == WIDE
            return out
        core = core_of(word)
        return self.cores[core[0]] + self.ones[core[1]] if core else steps_of(self.few_counts(word))

    def _load_merges(self) -> None:
        with open(self.enc.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = {p: r for r, p in enumerate(pairs)}
        self.vocab = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.longest = max(len(t.removesuffix(self.end)) for t in self.vocab)
        self.fit: dict = {}

    def _merge(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            rank, i = min((self.merges.get(p, 1 << 60), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            symbols = symbols[:i] + [symbols[i] + symbols[i + 1]] + symbols[i + 2 :]
        return symbols

    def _stays(self, a: str, b: str) -> bool:
        """Whether the merges leave the tokens a, b as they are, side by side."""
        if (a, b) not in self.fit:
            if len(self.fit) > 200_000:
                self.fit.clear()
            tail = b.removesuffix(self.end)
            last = [*tail[:-1], tail[-1] + self.end] if b != tail else [*tail]
            self.fit[a, b] = self._merge([*a, *last]) == [a, b]
        return self.fit[a, b]

    def run_counts(self, symbols: str) -> list[int]:
        """Counts of all prefixes of one pre-token (in the vocabulary's byte
        alphabet), in time linear in its length."""
        if self.merges is None:
            self._load_merges()
        n = len(symbols)
        inner: list = [(0, None)] + [None] * n  # count and last token of symbols[:j] inside a word
        out = []
        for j in range(1, n + 1):
            closed = None
            for k in range(min(j, self.longest), 0, -1):
                before = inner[j - k]
                if before is None:
                    continue
                t = symbols[j - k : j]
                if inner[j] is None and t in self.vocab and (k == 1 or self._merge([*t]) == [t]) and (before[1] is None or self._stays(before[1], t)):
                    inner[j] = (before[0] + 1, t)
                e = t + self.end
                if closed is None and e in self.vocab and (before[1] is None or self._stays(before[1], e)) and self._merge([*t[:-1], t[-1] + self.end]) == [e]:
                    closed = before[0] + 1
                if closed is not None and inner[j] is not None:
                    break
            out.append(closed)
        return out

    def long_counts(self, word: str) -> list[int]:
        """Counts of all prefixes of a long word: pre-token by pre-token."""
        t = self.enc.tokenizer
        out: list[int] = []
        total, at = 0, 0
        pieces = [(s, e, p) for p, (s, e) in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(word))]
        for s, e, p in pieces:
            per_byte = self.run_counts(p)
            ends = np.cumsum([len(c.encode()) for c in t.normalizer.normalize_str(word)[s:e]])
            out += [total] * (s - at) + [total + per_byte[x - 1] for x in ends]
            total, at = total + per_byte[-1], e
        return out + [total] * (len(word) - at)

    def plain(self, word: str) -> bool:
        """Whether a long word keeps its characters when normalised and holds no special string."""
        return unicodedata.is_normalized("NFC", word) and len(word.lower()) == len(word) and "<|" not in word

    def tables(self, texts: list[str]) -> list[bytes]:
        """For each text. First byte: the width of a difference; then one for each character."""
        if not self.enc.by_word:
            return [x if x[:1] == WIDE else NARROW + x for x in (steps_of(self.few_counts(t)) for t in texts)]
        for name in ("core_prefixes", "cores", "words"):
            own = getattr(self, name)
            if len(own) > 2 * KEPT:
                setattr(self, name, Lookup(own.make, dict(own)))
        known, out = self.words.__getitem__, []
        for split in split_words(map(folded, texts)):
            self.wide = False
            steps = list(map(known, split))
            # a narrow table is one byte for each character, a wide one holds its mark and four for each
            out.append(_widened(steps) if self.wide else NARROW + b"\x00".join(steps))
        return out

    def totals(self, texts: list[str]) -> list[int]:
        """Counts of whole texts; where no table is kept, other vocabularies encode each text once."""
        if not self.enc.by_word:
            return [len(x) for x in self.enc.lists(texts)]
        return [total_of(t) for t in self.tables(texts)]

    def few_counts(self, word: str) -> list[int]:
        """For words whose normal form moves characters: the library encodes each prefix."""
        return [len(x) for i in range(0, len(word), 256) for x in self.enc.lists([word[:j] for j in range(i + 1, min(i + 256, len(word)) + 1)])]


def _widened(steps: list[bytes]) -> bytes:
    gap = np.zeros(1, "<i4").tobytes()
    return WIDE + gap.join(x[1:] if x[:1] == WIDE else np.frombuffer(x, "i1").astype("<i4").tobytes() for x in steps)


def steps_of(counts: list[int]) -> bytes:
    """Differences of counts: signed bytes if all fit, else WIDE and four bytes for each."""
    if not counts:
        return b""
    d = [b - a for a, b in zip([0, *counts], counts)]
    if -127 <= min(d) and max(d) < 128:
        return bytes([x & 255 for x in d])
    return WIDE + np.array(d, "<i4").tobytes()


def prefix_counts(table: bytes) -> np.ndarray:
    """Counts of all prefixes, from that of no characters on."""
    d = np.frombuffer(table[1:], "<i4" if table[:1] == WIDE else "i1")
    return np.concatenate([[0], np.cumsum(d, dtype=np.int64)])


def count_at(table: bytes, chars: int) -> int:
    """Exact token count of the first ``chars`` characters."""
    return int(prefix_counts(table)[min(chars, len(prefix_counts(table)) - 1)])


def longest_within(table: bytes, budget: int) -> int:
    """Most characters of a prefix with ``budget`` tokens or fewer."""
    return int(np.flatnonzero(prefix_counts(table) <= budget)[-1])


def total_of(table: bytes) -> int:
    return int(np.frombuffer(table[1:], "<i4" if table[:1] == WIDE else "i1").sum(dtype=np.int64))


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(encoder(path))
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 2048, keep_table: bool = True) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit and, if kept,
    ``prefix_table``, which prefix_counts(), count_at() and longest_within() read.

    Null and empty texts have 0 bytes and tokens; rows are judged one by one, so
    repeated rows and null ids need no rule; an empty table gives no rows. A table
    takes time in proportion to the text for vocabularies whose words are
    independent, but for runs of more than LONG characters without a space that hold
    special strings or letters that normalising moves; there, and for all texts of
    other vocabularies, each prefix is encoded."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        count = counter(path)
        for b in batches:
            texts = text_list(b.column("text"))
            tables = count.tables(texts) if keep_table else []
            totals = [total_of(t) for t in tables] if keep_table else count.totals(texts)
            cols = {"doc_id": b.column("doc_id"), "n_bytes": b.column("n_bytes"), "n_tokens": pa.array(totals, pa.int64())}
            if keep_table:
                cols["prefix_table"] = pa.array(tables, pa.binary())
            yield pa.RecordBatch.from_pydict(cols)

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long" + ", prefix_table binary" * keep_table)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    from .common import small_batches, table

    small_batches(spark)
    return token_counts(table(spark, sf_dir, "documents"), keep_table=False)
