"""Language identification by bit-sliced Bloom filters of n-grams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import mix, text_bytes
from .cluster import add_columns, ship_code, without

#: Learned from the documents with the smallest hashes of their ids, so many at most.
SAMPLE_DOCS = 30_000
#: An n-gram belongs to a language if it makes up this share of the language's n-grams, which
#: also bounds their number, and ...
LEAST_SHARE = 2e-5
#: ... at least this part of its largest share in any language.
NEAR_LARGEST = 0.4
SLOTS = 1 << 19
#: A task counts so many n-grams at a time.
COUNTED = 4_000_000
HASHES = 2
_BLANK = 0x20
_BLOCK = 1 << 20


def _codes(texts):
    """For blocks of consecutive texts: (index of the first, n-gram codes, text of each code).

    N-grams are 3 or 4 bytes of a word with a blank on either side, A-Z in lower case; words are
    runs of ASCII letters and of anything beyond ASCII. A code holds the bytes themselves.
    """
    fold = np.full(256, _BLANK, dtype=np.uint32)
    for c in range(256):
        if c >= 0x80 or chr(c).isalpha():
            fold[c] = c + 32 if 0x41 <= c <= 0x5A else c
    data, cuts = text_bytes(texts)
    i, n = 0, len(cuts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + _BLOCK, side="right")) - 1)
        sizes = np.diff(cuts[i : j + 1])
        owner = np.repeat(np.arange(j - i), sizes)
        # A blank before each text and after the last.
        padded = np.full(int(sizes.sum()) + j - i + 1, _BLANK, dtype=np.uint32)
        padded[np.arange(len(owner)) + owner + 1] = fold[data[cuts[i] : cuts[j]]]
        of = np.repeat(np.arange(j - i), sizes + 1)
        letter = padded != _BLANK
        out, owners = [], []
        if len(padded) >= 3:
            three = np.flatnonzero(letter[1:-1])
            code = (padded[three] << 16) | (padded[three + 1] << 8) | padded[three + 2]
            out.append(code.astype(np.uint64))
            # A text's n-gram may begin at the blank before it and end at the blank before the next.
            owners.append(of[three])
        if len(padded) >= 4:
            four = np.flatnonzero(letter[1:-2] & letter[2:-1])
            code = (padded[four] << 24) | (padded[four + 1] << 16) | (padded[four + 2] << 8) | padded[four + 3]
            out.append(code.astype(np.uint64) | np.uint64(1 << 32))
            owners.append(of[four])
        codes = np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)
        yield i, codes, np.concatenate(owners) if owners else np.zeros(0, dtype=np.int64), j - i
        i = j


class LanguageFilters:
    """One Bloom filter for each language, stored by slot: a slot is a bit mask of languages."""

    def __init__(self, languages: list[str], masks: np.ndarray):
        self.languages, self.masks = languages, masks
        #: Chance that a filter holds an n-gram that was never put in.
        self.false = np.array([self._filled(k) ** HASHES for k in range(len(languages))])

    def _filled(self, k: int) -> float:
        return float(((self.masks[:, k // 8] >> np.uint8(k % 8)) & np.uint8(1)).mean())

    @staticmethod
    def slots(codes: np.ndarray) -> list[np.ndarray]:
        h = mix(codes + np.uint64(0x5851F42D4C957F2D))
        return [((h >> np.uint64(32 * k)) & np.uint64(0xFFFFFFFF)) % np.uint64(SLOTS) for k in range(HASHES)]

    @classmethod
    def build(cls, languages: list[str], members: list[np.ndarray]) -> LanguageFilters:
        masks = np.zeros((SLOTS, max(1, -(-len(languages) // 8))), dtype=np.uint8)
        for k, codes in enumerate(members):
            for s in cls.slots(codes):
                masks[s.astype(np.int64), k // 8] |= np.uint8(1 << (k % 8))
        return cls(languages, masks)

    def predict(self, texts) -> tuple[list[str], list[float]]:
        """Best language of each text and the corrected share of its n-grams in that language's
        filter. Ties go to the name that sorts first; "und" if a text has no letter."""
        n_lang = len(self.languages)
        bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
        names, scores = [], []
        for i, codes, owner, n in _codes(texts):
            slots = [s.astype(np.int64) for s in self.slots(codes)]
            hits = np.zeros((n, n_lang), dtype=np.int64)
            for byte in range(self.masks.shape[1]):
                column = self.masks[:, byte]
                mask = column[slots[0]]
                for s in slots[1:]:
                    mask &= column[s]
                lo = 8 * byte
                table = np.bincount(owner * 256 + mask, minlength=n * 256).reshape(n, 256) @ bits
                hits[:, lo : lo + 8] = table[:, : n_lang - lo]
            total = np.bincount(owner, minlength=n)
            share = np.clip((hits - total[:, None] * self.false) / np.maximum(total[:, None] * (1 - self.false), 1e-9), 0, 1)
            for d in range(n):
                # any() ends at the first letter, which is soon but in texts of signs.
                if not n_lang or not any(map(str.isalpha, texts[i + d].as_py() or "")):
                    names.append("und")
                    scores.append(0.0)
                else:
                    best = int(share[d].argmax())
                    names.append(self.languages[best])
                    scores.append(float(share[d, best]))
        return names, scores


def count_ngrams(docs: DataFrame, text: Column, lang: Column) -> DataFrame:
    """(lang, code, n): n-grams counted, first within each task."""
    ship_code(docs.sparkSession)

    def counted(parts: dict[str, list]):
        import pyarrow as pa

        names, codes, counts = [], [], []
        for name, own in parts.items():
            code, n = np.unique(np.concatenate(own), return_counts=True)
            names += [name] * len(code)
            codes.append(code.astype(np.int64))
            counts.append(n.astype(np.int64))
        parts.clear()
        none = np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate([none, *codes])), pa.array(np.concatenate([none, *counts]))], names=["lang", "code", "n"])

    def run(batches):
        parts, held = {}, 0
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for i, codes, owner, n in _codes(batch.column(0)):
                own = langs[i : i + n]
                for name in set(own.tolist()):
                    parts.setdefault(name, []).append(codes[np.isin(owner, np.flatnonzero(own == name))])
                held += len(codes)
            if held >= COUNTED:
                yield counted(parts)
                held = 0
        yield counted(parts)

    found = docs.select(text.cast("string").alias("t"), lang.cast("string").alias("l")).mapInArrow(run, "lang string, code long, n long")
    return found.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def fit_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, least_share: float = LEAST_SHARE
) -> LanguageFilters:
    """Filters learned from rows with a text and a language, from `sample_docs` of them at most.

    What reaches the driver is n-grams with a share of `least_share` in a language, at most
    1 / least_share for each language."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    limit = known.select(F.xxhash64(id_col).alias("h")).orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    chosen = known.where(F.xxhash64(id_col) <= F.lit(limit if limit is not None else 0))
    counts = count_ngrams(chosen, F.col(text_col), F.col(lang_col)).persist()
    try:
        totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        by_lang = counts.join(F.broadcast(counts.groupBy("lang").agg(F.sum("n").alias("total"))), "lang")
        frequent = by_lang.where(F.col("n") >= F.lit(least_share) * F.col("total")).select("lang", "code", (F.col("n") / F.col("total")).alias("s"))
        rows = frequent.toArrow()
    finally:
        counts.unpersist()
    languages = sorted(totals)
    lang = np.array(rows.column("lang").to_pylist(), dtype=object)
    code = rows.column("code").to_numpy().astype(np.uint64)
    share = rows.column("s").to_numpy()
    every, place = np.unique(code, return_inverse=True)
    largest = np.zeros(len(every))
    np.maximum.at(largest, place, share)
    keep = share >= NEAR_LARGEST * largest[place] if len(every) else np.zeros(0, dtype=bool)
    return LanguageFilters.build(languages, [code[keep & (lang == name)] for name in languages])


FIELDS = [T.StructField("_lang_pred", T.StringType()), T.StructField("_score", T.DoubleType())]


def identify(docs: DataFrame, filters: LanguageFilters, text_col: str = "text") -> DataFrame:
    """docs with _lang_pred and _score (0 to 1).

    For each n-gram of a text one lookup gives all languages that have it; hits are counted by
    language, less those that the filter's false positives explain.

    Defined cases: "und" with score 0 for a null text, one without a letter, and when nothing was
    learned; among equal scores the language that sorts first; whole texts are read, however long;
    repeated rows each give a row; an input column with the name of a result is replaced; an empty
    table gives an empty table.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((filters.languages, filters.masks))

    def make(batches):
        own = LanguageFilters(*shipped.value)
        for (texts,) in batches:
            yield list(own.predict(texts))

    return add_columns(without(docs, [f.name for f in FIELDS]), make, FIELDS, [text_col])
