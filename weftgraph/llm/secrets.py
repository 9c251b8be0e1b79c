"""Secrets by a linear-chain conditional random field, beside fixed patterns.

Tokens of a line are tagged as begin of a secret, inside or outside. What the field sees of a token
is its shape, its own and its neighbours' words, the characters between them, and features of the
whole file; Viterbi decodes each line.
"""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytewords import WordSplitter
from .cluster import add_columns, ship_code, without
from .spans import Span, ascii_lower, digest, joined

BASE = ["assign", "access", "hex"]
KINDS = [*BASE, "crf"]
OUT, BEGIN, INSIDE = 0, 1, 2

#: The field is fitted on the documents with the smallest hashes of their ids, so many at most, ...
SAMPLE_DOCS = 3_000
#: ... on so many lines without a secret for one with a secret, ...
PLAIN_LINES = 1
#: ... of a line on so many tokens, around its secret if it has one, ...
LINE_TOKENS = 16
#: ... and of a document on so many tokens: 200,000 of 33 bytes reach the driver at most.
DOC_TOKENS = 64
#: In documents without a secret, which nearly all are, one is planted to learn from: a word that
#: announces it, a sign, and a value made by one of SHAPES.
CUES = ("password", "passwort", "pwd", "secret", "token", "key", "api key", "auth", "bearer", "credential", "pass", "clave", "contraseña", "mot de passe", "schlüssel", "")
SIGNS = ("=", ": ", " ", " = ", ":", " is ", '="', ": '")
#: The fit works on so many tokens at a time.
FIT_TOKENS = 1 << 16
#: Features that hold words. Lines with a secret are learned from a second time without them, so
#: that the field knows a secret by its shape too, where it stands among other words.
WORD_FEATURES = (2, 3, 4)
#: Pseudo-random hash buckets of words.
WORDS = 1 << 12

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

_LOWER_HEX = WordSplitter(np.frombuffer(b"0123456789abcdef", dtype=np.uint8))
_TOKEN_BYTES = np.array([c for c in range(256) if c >= 0x80 or chr(c).isalnum() or chr(c) in "+/_.-"])


def base_spans(text: str, hex_runs: list[tuple[int, int]]) -> list[Span]:
    """Spans of the fixed patterns; hex_runs are the runs of 16 or more of 0-9a-f."""
    out: list[Span] = []
    low = ascii_lower(text)
    if any(n in low for n in _NAMES):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    return out + [("hex", a, b) for a, b in hex_runs]


def _positions(raw: np.ndarray, at: list[int]) -> list[int]:
    """Code points before each of these byte positions."""
    before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return before[at].tolist()


class Features:
    """Values of categorical features of all tokens of a block of texts."""

    splitter = None

    #: Number of values of each feature: shape, changes between letters and digits, word, word
    #: before, word after, what stands before, what stands after, the file.
    sizes = (5 * 128, 6, WORDS, WORDS, WORDS, 16, 16, 8)

    def __init__(self):
        if Features.splitter is None:
            Features.splitter = WordSplitter(_TOKEN_BYTES)
        kind = np.zeros((256, 7), dtype=np.uint8)
        for c in range(256):
            s = chr(c)
            if c >= 0x80:
                kind[c, 4] = 1
            elif s.isdigit():
                kind[c, 0] = 1
            elif s.islower():
                kind[c, 1] = 1
                kind[c, 6] = s > "f"
            elif s.isupper():
                kind[c, 2] = 1
                kind[c, 6] = 1
            else:
                kind[c, 3] = 1
                kind[c, 5] = s in "+/_-"
        self.kind = kind @ (1 << np.arange(7)).astype(np.uint8)
        self.digit = kind[:, 0].astype(np.int8)
        gap = np.zeros(256, dtype=np.uint8)
        gap[ord("=")] = 1
        gap[ord(":")] = 2
        gap[[ord('"'), ord("'"), ord("`")]] = 4
        gap[ord("\n")] = 8
        self.gap = gap

    def of(self, data, cuts, starts, ends, first, hashes) -> np.ndarray:
        n = len(starts)
        if not n:
            return np.zeros((len(self.sizes), 0), dtype=np.int32)
        length = ends - starts
        size = np.searchsorted([4, 8, 12, 20], length, side="right")
        # Bits of what occurs in a token; the bytes between tokens are cut off by reducing over
        # starts and ends in turn.
        edges = np.empty(2 * n, dtype=np.int64)
        edges[0::2], edges[1::2] = starts, ends
        closed = edges if edges[-1] < len(data) else edges[:-1]
        shape = np.bitwise_or.reduceat(self.kind[data], closed)[0::2]
        digit = self.digit[data]
        total = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(digit[1:] != digit[:-1], out=total[2:])
        changes = np.minimum(total[ends] - total[starts + 1], 5)
        gaps = np.bitwise_or.reduceat(self.gap[data], closed)[1::2]
        after = np.zeros(n, dtype=np.int32)
        after[: len(gaps)] = gaps
        # The bytes between a text's last token and the next text's first belong to both texts.
        after[first[1:][first[1:] > 0] - 1] |= 8
        before = np.full(n, 8, dtype=np.int32)
        before[1:] = after[:-1]
        word = (hashes % np.uint64(WORDS)).astype(np.int32)
        prev, nxt = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        prev[1:], nxt[:-1] = word[:-1], word[1:]
        prev[before >= 8] = 0
        nxt[after >= 8] = 0
        mixed = ((shape & 1) > 0) & ((shape & 6) > 0)
        counts = np.diff(first)
        per_doc = np.diff(np.concatenate([[0], np.cumsum(mixed)])[first]) * 50 // np.maximum(counts, 1)
        file = np.minimum(per_doc, 3) + 4 * (counts < 200)
        return np.stack([size.astype(np.int32) * 128 + shape, changes.astype(np.int32), word, prev, nxt, before, after, np.repeat(file, counts).astype(np.int32)])


class Field:
    """Weights of a linear chain: one table per feature, and transitions with start."""

    def __init__(self, tables: list[np.ndarray], moves: np.ndarray, start: np.ndarray):
        self.tables, self.moves, self.start = tables, moves, start

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((features.shape[1], 3), dtype=np.float32)
        for table, values in zip(self.tables, features, strict=True):
            out += table[values]
        return out

    def bound(self) -> float:
        """A token whose score for outside leads by more than this is outside in any best path of
        a line of such tokens: each tagged token changes two transitions at most."""
        gain = max(float(self.moves.max() - self.moves[OUT, OUT]), float(self.start.max() - self.start[OUT]), 0.0)
        return 2 * gain

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """Tags of the best path through one line."""
        best, back = self.start + scores[0], []
        for s in scores[1:]:
            ways = best[:, None] + self.moves
            back.append(ways.argmax(0))
            best = ways.max(0) + s
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]


def fit_field(features: np.ndarray, tags: np.ndarray, line: np.ndarray, rounds: int = 30, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Maximum likelihood by full-batch AdaGrad with forward and backward sums. `line` numbers the
    line of each token, in order. Lines are worked on side by side, those of like length together."""
    sizes = Features.sizes
    theta = [np.zeros((n, 3)) for n in sizes] + [np.zeros((3, 3)), np.zeros(3)]
    theta[-2][OUT, INSIDE] = -4.0
    theta[-1][INSIDE] = -4.0
    past = [np.full(t.shape, 1e-6) for t in theta]
    if features.shape[1]:
        begins = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        lengths = np.diff(np.append(begins, len(line)))
        groups = [np.flatnonzero(lengths == n) for n in np.unique(lengths)]
        parts = [g[i : i + each] for g in groups for each in [max(1, FIT_TOKENS // int(lengths[g[0]]))] for i in range(0, len(g), each)]
        hot = np.eye(3)[tags]
        for _ in range(rounds):
            scores = sum(t[v] for t, v in zip(theta, features, strict=False))
            moves, start = theta[-2], theta[-1]
            grad = [np.zeros_like(t) for t in theta]
            marginals = np.empty_like(scores)
            for g in parts:
                at = begins[g][:, None] + np.arange(lengths[g[0]])
                s = scores[at]
                n = s.shape[1]
                alpha, beta = np.empty_like(s), np.zeros_like(s)
                alpha[:, 0] = start + s[:, 0]
                for i in range(1, n):
                    alpha[:, i] = s[:, i] + np.logaddexp.reduce(alpha[:, i - 1, :, None] + moves, axis=1)
                for i in range(n - 2, -1, -1):
                    beta[:, i] = np.logaddexp.reduce(moves + (s[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2)
                z = np.logaddexp.reduce(alpha[:, -1], axis=1)
                m = np.exp(alpha + beta - z[:, None, None])
                marginals[at] = m
                if n > 1:
                    pair = alpha[:, :-1, :, None] + moves + (s[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]
                    real = np.einsum("lta,ltb->ab", hot[at[:, :-1]], hot[at[:, 1:]])
                    grad[-2] += real - np.exp(pair).sum((0, 1))
                grad[-1] += (hot[at[:, 0]] - m[:, 0]).sum(0)
            off = hot - marginals
            for k, v in enumerate(features):
                for tag in range(3):
                    grad[k][:, tag] = np.bincount(v, weights=off[:, tag], minlength=sizes[k])
            for t, g, p in zip(theta, grad, past, strict=True):
                g -= decay * t
                p += g * g
                t += rate * g / np.sqrt(p)
    *tables, moves, start = [t.astype(np.float32) for t in theta]
    return Field(tables, moves, start)


def _lines(features: np.ndarray) -> np.ndarray:
    """First token of each line, with the number of tokens at the end."""
    return np.append(np.flatnonzero(features[5] >= 8), features.shape[1])


def _blocks(texts, known: Features):
    """(index of first text, bytes, cuts, token starts, ends, first, features, hex runs by text)."""
    for i, data, cuts, starts, ends, first, hashes in known.splitter.batches(texts):
        a, b, f = _LOWER_HEX.split(data, cuts)
        far = np.flatnonzero(b - a >= 16)
        owner = np.searchsorted(f, far, side="right") - 1
        runs: dict[int, list] = {}
        for d, s, e in zip(owner.tolist(), a[far].tolist(), b[far].tolist(), strict=True):
            runs.setdefault(d, []).append((s, e))
        yield i, data, cuts, starts, ends, first, known.of(data, cuts, starts, ends, first, hashes), runs



def _base_of(text: str, raw: np.ndarray, origin: int, runs: list) -> list[Span]:
    if not runs:
        return base_spans(text, [])
    flat = _positions(raw, [x - origin for r in runs for x in r])
    return base_spans(text, list(zip(flat[0::2], flat[1::2], strict=True)))


_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def _chars(r: random.Random, pool: str, least: int, most: int) -> str:
    """Characters of the pool, a digit and a letter among them."""
    while True:
        out = "".join(r.choice(pool) for _ in range(r.randint(least, most)))
        if not out.isalpha() and not out.isdigit():
            return out


SHAPES = {
    "hex": lambda r: _chars(r, _DIGITS + "abcdef", 16, 48),
    "upper hex": lambda r: _chars(r, _DIGITS + "ABCDEF", 16, 48),
    "lower": lambda r: _chars(r, _LETTERS + _DIGITS, 10, 40),
    "upper": lambda r: _chars(r, _LETTERS.upper() + _DIGITS, 12, 32),
    "mixed": lambda r: _chars(r, _LETTERS + _LETTERS.upper() + _DIGITS, 10, 44),
    "base64": lambda r: _chars(r, _LETTERS + _LETTERS.upper() + _DIGITS + "+/", 20, 60) + "=" * r.randint(0, 2),
    "named": lambda r: f"{''.join(r.choice(_LETTERS) for _ in range(r.randint(2, 4)))}{r.choice('_-')}{_chars(r, _LETTERS + _LETTERS.upper() + _DIGITS, 16, 40)}",
    "grouped": lambda r: "-".join(_chars(r, _LETTERS.upper() + _DIGITS, 4, 5) for _ in range(r.randint(3, 5))),
    "signs": lambda r: r.choice("!$%&*#").join(_chars(r, _LETTERS + _LETTERS.upper() + _DIGITS, 4, 9) for _ in range(r.randint(2, 3))),
}


def plant(text: str, r: random.Random, shapes: list[str]) -> tuple[str, int, int]:
    """The text with a secret put before one of its words, and the secret's start and end."""
    places = [m.start() for m in re.finditer(r"(?<!\S)\S", text)] or [len(text)]
    at = r.choice(places)
    value = SHAPES[r.choice(shapes)](r)
    cue = r.choice(CUES)
    cue = r.choice([cue, cue.upper(), cue.capitalize()])
    lead = cue + r.choice(SIGNS) if cue else ""
    close = lead[-1] if lead[-1:] in ("'", '"') else ""
    return f"{text[:at]}{lead}{value}{close} {text[at:]}", at + len(lead), at + len(lead) + len(value)


def labelled_lines(texts, known: Features, withhold: tuple[str, ...] = (), shapes: list[str] = tuple(SHAPES)):
    """(features, tags) of lines to learn from, for each text at most DOC_TOKENS tokens.

    A text without a secret has one planted, as the text's own checksum says. A token is in a secret
    if a pattern's value or a planted one covers it; runs of digits alone are not taken for secrets.
    Of a line with secrets LINE_TOKENS around the first one are taken, and with each such line some
    plain ones, cut to as many from a place that depends on their words. Planted values have the
    given shapes; lines with a match of a pattern in `withhold` are left out."""
    strings = [t or "" for t in texts.to_pylist()]
    planted: dict[int, tuple[int, int]] = {}
    if shapes:
        for d, text in enumerate(strings):
            if text and not base_spans(text, [m.span() for m in re.finditer("[0-9a-f]{16,}", text)]):
                text, a, b = plant(text, random.Random(zlib.crc32(text.encode())), list(shapes))
                strings[d], planted[d] = text, (a, b)
    import pyarrow as pa

    for i, data, cuts, starts, ends, first, features, runs in _blocks(pa.array(strings, pa.large_string()), known):
        tags = np.zeros(len(starts), dtype=np.int8)
        unused = np.zeros(len(starts), dtype=bool)
        for d in range(len(first) - 1):
            text = strings[i + d]
            if not text:
                continue
            raw = data[cuts[d] : cuts[d + 1]]
            own_spans = [("planted", *planted[i + d])] if i + d in planted else _base_of(text, raw, int(cuts[d]), runs.get(d, []))
            for kind, a, b in own_spans:
                if kind == "assign":
                    a = ASSIGN.match(text, a).start(2)
                elif kind == "hex" and text[a:b].isdigit():
                    continue
                s, e = int(cuts[d]) + len(text[:a].encode()), int(cuts[d]) + len(text[:b].encode())
                lo, hi = np.searchsorted(ends, s, side="right"), np.searchsorted(starts, e)
                if kind in withhold:
                    unused[lo:hi] = True
                elif lo < hi and not tags[lo:hi].any():
                    tags[lo], tags[lo + 1 : hi] = BEGIN, INSIDE
        line = _lines(features)
        if len(line) < 2:
            continue
        some = np.logical_or.reduceat(tags > 0, line[:-1])
        use = ~np.logical_or.reduceat(unused, line[:-1])
        owner = np.searchsorted(first, line[:-1], side="right") - 1
        for d in np.unique(owner).tolist():
            own = np.flatnonzero((owner == d) & use)
            secret, plain = own[some[own]], own[~some[own]]
            plain = plain[:: max(1, -(-len(plain) // (PLAIN_LINES * len(secret) + 1)))]
            left = DOC_TOKENS
            # By turns, so that neither kind uses up what is left.
            for k in np.concatenate([np.stack([secret[: len(plain)], plain[: len(secret)]], 1).ravel(), secret[len(plain) :], plain[len(secret) :]]).astype(np.int64).tolist():
                lo, hi = int(line[k]), int(line[k + 1])
                if hi - lo > LINE_TOKENS:
                    at = lo + int(tags[lo:hi].argmax()) - LINE_TOKENS // 2 if some[k] else lo + int(features[2, lo]) % (hi - lo - LINE_TOKENS + 1)
                    lo = min(max(at, lo), hi - LINE_TOKENS)
                    hi = lo + LINE_TOKENS
                if hi - lo > left:
                    break
                left -= hi - lo
                own_tags = tags[lo:hi].copy()
                if own_tags[0] == INSIDE:
                    own_tags[0] = BEGIN
                yield features[:, lo:hi], own_tags


def training_lines(docs: DataFrame, id_col: str, text_col: str, sample_docs: int) -> DataFrame:
    """Lines to fit on, from the sampled documents, as packed arrays: features, tags. An id on
    several rows is a document of which one row is taken."""
    ship_code(docs.sparkSession)
    docs = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).where("i is not null and t is not null")
    hashed = docs.select(F.xxhash64("i").alias("h")).distinct()
    limit = hashed.orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    chosen = docs.where(F.xxhash64("i") <= F.lit(limit if limit is not None else 0))

    def run(batches):
        import pyarrow as pa

        known = Features()
        for batch in batches:
            for k in range(len(batch)):
                found = list(labelled_lines(batch.column(1).slice(k, 1), known))
                f = pa.array([[np.ascontiguousarray(x, dtype=np.int32).tobytes() for x, _ in found]], pa.list_(pa.binary()))
                t = pa.array([[x.tobytes() for _, x in found]], pa.list_(pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), f, t], names=["i", "f", "t"])

    found = chosen.withColumn("i", F.xxhash64("i")).mapInArrow(run, "i long, f array<binary>, t array<binary>")
    once = found.groupBy("i").agg(F.min(F.struct("f", "t")).alias("r"))
    return once.select(F.explode(F.arrays_zip("r.f", "r.t")).alias("x")).select("x.f", "x.t")


def fit_lines(lines: list[tuple[np.ndarray, np.ndarray]]) -> Field:
    """A field fitted on lines of (features, tags), those with a secret a second time without words."""
    k = len(Features.sizes)
    features = np.concatenate([np.zeros((k, 0), dtype=np.int32), *[f for f, _ in lines]], axis=1)
    tags = np.concatenate([np.zeros(0, dtype=np.int8), *[t for _, t in lines]])
    line = np.repeat(np.arange(len(lines)), [len(t) for _, t in lines])
    secret = np.isin(line, [i for i, (_, t) in enumerate(lines) if t.any()])
    bare = features[:, secret]
    bare[list(WORD_FEATURES)] = 0
    return fit_field(np.concatenate([features, bare], axis=1), np.concatenate([tags, tags[secret]]).astype(np.int64), np.concatenate([line, line[secret] + len(lines)]))


def fit_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> Field:
    """A field fitted on a bounded sample: of SAMPLE_DOCS documents DOC_TOKENS tokens each.

    Defined cases: rows without id or text are left out; an id on several rows counts once; without
    any lines the field's weights are those it starts with, and it tags nothing; other columns are
    ignored."""
    rows = training_lines(docs, id_col, text_col, sample_docs).collect()
    rows.sort(key=lambda r: (r.f, r.t))
    k = len(Features.sizes)
    return fit_lines([(np.frombuffer(r.f, dtype=np.int32).reshape(k, -1), np.frombuffer(r.t, dtype=np.int8)) for r in rows])


FIELDS = [T.StructField(f"_n_{k}", T.LongType()) for k in BASE] + [T.StructField("_base_sha256", T.StringType()), T.StructField("_spans", T.StringType())]


class Scanner:
    """Finds the spans of texts by the patterns and a field."""

    def __init__(self, field: Field):
        self.known, self.field, self.bound = Features(), field, field.bound()

    def spans(self, texts) -> list[tuple[list[Span], list[Span]]]:
        """(spans of the patterns, spans that the field adds) of each text."""
        strings = texts.to_pylist()
        out = []
        for i, data, cuts, starts, ends, first, features, runs in _blocks(texts, self.known):
            scores = self.field.scores(features)
            open_ = scores[:, OUT] - scores[:, 1:].max(1) <= self.bound
            line = _lines(features)
            added: dict[int, list] = {}
            busy = np.unique(np.searchsorted(line, np.flatnonzero(open_), side="right") - 1)
            for k in busy.tolist():
                lo, hi = int(line[k]), int(line[k + 1])
                tags = self.field.viterbi(scores[lo:hi])
                d = int(np.searchsorted(first, lo, side="right")) - 1
                for j, tag in enumerate(tags):
                    if tag == BEGIN or tag == INSIDE and (j == 0 or tags[j - 1] == OUT):
                        added.setdefault(d, []).append([int(starts[lo + j]), int(ends[lo + j])])
                    elif tag == INSIDE:
                        added[d][-1][1] = int(ends[lo + j])
            for d in range(len(first) - 1):
                text = strings[i + d] or ""
                raw, origin = data[cuts[d] : cuts[d + 1]], int(cuts[d])
                base = _base_of(text, raw, origin, runs.get(d, [])) if text else []
                more: list[Span] = []
                if d in added:
                    flat = _positions(raw, [x - origin for r in added[d] for x in r])
                    more = [("crf", a, b) for a, b in zip(flat[0::2], flat[1::2], strict=True) if all(b <= x or y <= a for _, x, y in base)]
                out.append((base, more))
        return out


def scan_secrets(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """docs with columns _n_assign, _n_access, _n_hex (long), _base_sha256 (of the patterns' spans)
    and _spans (all, as kind:start:end joined by commas, in code points, end exclusive).

    The field adds spans of kind `crf` where no pattern has matched. Lines where every token leads
    for outside by more than the transitions can make up need no decoding.

    Whole texts are read, in blocks; a very long line is decoded whole. Defined cases: a null or
    empty text has no spans; among equally good paths the one with the lower tags at the end; an
    input column with the name of a result is replaced; repeated rows each give a row; an empty
    table gives an empty table.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((field.tables, field.moves, field.start))

    def make(batches):
        scanner = Scanner(Field(*shipped.value))
        for (texts,) in batches:
            found = scanner.spans(texts)
            counts = [[sum(s[0] == kind for s in base) for base, _ in found] for kind in BASE]
            yield [*counts, [digest(base, BASE) for base, _ in found], [joined(base + more, KINDS) for base, more in found]]

    return add_columns(without(docs, [f.name for f in FIELDS]), make, FIELDS, [text_col])
