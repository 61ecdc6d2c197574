"""Secret scans: fixed patterns, and a conditional random field for the rest.

A text's tokens are runs of the characters that secrets are written in, and
runs of other punctuation. Each is described by its shape (length, kinds of
characters, changes between them), by the words around it and by features of
the file (density of digits and of assignments). The field is trained on a
bounded sample of the corpus: what the patterns find there, the same files
with invented secrets and lookalikes (addresses, identifiers, paths) put in,
and files without any. It tags tokens as begin,
inside or outside of a secret; spans that touch no pattern's span are added.

Defined cases: a null text is an empty one; without any document nothing is
trained and only patterns count; rows are independent, so ties and repeats
need no rule; an empty table gives an empty result; all other columns are
kept, those named like the operator's own are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vframe.llm import crf
from vframe.llm.shingles import BYTE_VALUES, mix, powers

#: Documents drawn to train on, and of those the ones kept with and without a find.
DRAWN, WITH_FIND, WITHOUT_FIND = 12_000, 300, 300
#: Tokens on each side of a window's centre; windows that a text gives to the fit about its secrets, and others.
AROUND, ABOUT, ELSEWHERE = 8, 6, 3

# The patterns and least lengths of the base kinds.
PATTERNS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
KINDS = (*PATTERNS, "crf")
_HINTS = (b"password", b"passwd", b"secret", b"token", b"api")


def base_spans(text: str, raw: bytes, longest: int) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start and then kind; ``longest`` is the longest token's length."""
    out = []
    lower = raw.lower()
    wanted = {"assign": any(h in lower for h in _HINTS), "access": b"AKIA" in raw, "hex": longest >= PATTERNS["hex"][2]}
    for kind, (pattern, group, least) in PATTERNS.items():
        if wanted[kind]:
            out += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# kinds of bytes
_CLASS = np.full(256, 2, dtype=np.int8)
_CLASS[[*range(9, 14), 32]] = 0
_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-", *range(128, 256)]] = 1
_BITS = np.zeros((256, 6), dtype=bool)  # lower, upper, digit, symbol, beyond ASCII, not hexadecimal
_BITS[97:123, 0] = _BITS[65:91, 1] = _BITS[48:58, 2] = True
_BITS[[*b"+/_=.-"], 3] = True
_BITS[128:, 4] = True
_BITS[:, 5] = ~np.isin(np.arange(256), [*b"0123456789abcdef"])
_PACKED = (_BITS << np.arange(6)).sum(axis=1).astype(np.uint8)
_SHAPE = np.select([_BITS[:, 2], _BITS[:, 1]], [1, 2], 0)  # of letters and digits, for changes

_LENGTHS = np.array([2, 4, 6, 8, 12, 16, 20, 24, 32, 40, 64])
_WORDS = 1 << 11
_GROUPS = (len(_LENGTHS) + 1, 64 * 5, 4 * 8, 64, _WORDS, _WORDS, _WORDS, _WORDS, 4 * 4, 4 * 3, 4 * 5 * 4)
_AT = np.cumsum((0, *_GROUPS))
SIZE = int(_AT[-1])


def tokens(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each token, in bytes."""
    kind = np.concatenate(([0], _CLASS[buffer], [0]))
    edge = np.flatnonzero(kind[1:] != kind[:-1])
    kept = kind[edge + 1] != 0
    starts = edge[kept]
    ends = edge[np.flatnonzero(kept) + 1]
    return starts, ends


def describe(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """Feature numbers, tokens x groups; ``doc`` is each token's document."""
    n = len(starts)
    length = ends - starts
    packed = np.bitwise_or.reduceat(_PACKED[buffer], np.stack((starts, ends), axis=1).ravel()[: 2 * n - (ends[-1] == len(buffer))])[::2]
    power, inverse = powers(len(buffer))
    total = np.zeros(len(buffer) + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[buffer] * power[: len(buffer)], out=total[1:])
    word = (mix((total[ends] - total[starts]) * inverse[starts]) >> np.uint64(53)).astype(np.int64)
    digits = np.concatenate(([0], np.cumsum(_BITS[buffer, 2], dtype=np.int64)))
    change = np.concatenate(([0, 0], np.cumsum(_SHAPE[buffer[1:]] != _SHAPE[buffer[:-1]], dtype=np.int64)))[: len(buffer) + 1]
    own_digits, own_changes = digits[ends] - digits[starts], change[ends] - change[np.minimum(starts + 1, ends)]
    share = np.minimum(3, own_digits * 4 // np.maximum(length, 1))
    file_digits, file_equals = np.bincount(doc, own_digits, docs), np.bincount(doc, packed & 8 > 0, docs)
    size = np.maximum(np.bincount(doc, length, docs), 1)
    dense = np.digitize(file_digits / size, (0.002, 0.02, 0.1))[doc]
    marks = np.digitize(file_equals / size, (0.001, 0.02))[doc]

    def occurs(mark: int, most: int) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(buffer == mark)))
        return np.minimum(total[ends] - total[starts], most)

    def shifted(by: int) -> np.ndarray:
        out, same = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        if by > 0:
            out[by:], same[by:] = word[:-by], doc[by:] == doc[:-by]
        else:
            out[:by], same[:by] = word[-by:], doc[:by] == doc[-by:]
        return np.where(same, out, 0)

    name = np.where((length <= 12) & (own_digits == 0), word, 0)
    groups = (
        np.digitize(length, _LENGTHS),
        packed.astype(np.int64) * 5 + np.digitize(length, (6, 12, 20, 32)),
        share * 8 + np.minimum(7, own_changes),
        np.minimum(63, length),
        name,
        shifted(1),
        shifted(2),
        shifted(-1),
        dense * 4 + share,
        marks * 4 + np.minimum(3, own_changes),
        occurs(ord("/"), 3) * 20 + occurs(ord("-"), 4) * 4 + occurs(ord("."), 3),
    )
    return np.stack([g + at for g, at in zip(groups, _AT, strict=False)], axis=1)


def _slices(raws: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    first, size = 0, 0
    for i, r in enumerate(raws):
        size += len(r)
        if size >= 1 << 20:
            yield first, raws[first : i + 1]
            first, size = i + 1, 0
    if first < len(raws):
        yield first, raws[first:]


def _parsed(raws: list[bytes]):
    """(buffer, bounds, starts, ends, doc) of texts joined by line ends."""
    buffer = np.frombuffer(b"\n".join(raws), dtype=np.uint8)
    bounds = np.cumsum([0, *(len(r) + 1 for r in raws)])
    starts, ends = tokens(buffer)
    return buffer, bounds, starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def scan(texts: list[str | None], model: crf.Crf | None) -> list[list[tuple[int, int, str]]]:
    """All spans of each text."""
    raws, out = [(t or "").encode("utf-8", "surrogatepass") for t in texts], []
    for first, part in _slices(raws):
        buffer, bounds, starts, ends, doc = _parsed(part)
        at = np.searchsorted(doc, np.arange(len(part) + 1))
        length = ends - starts
        emissions = model.emissions(describe(buffer, starts, ends, doc, len(part))) if model is not None and len(starts) else None
        longest = np.zeros(len(part), dtype=np.int64)
        np.maximum.at(longest, doc, length)
        for d, raw in enumerate(part):
            text = texts[first + d] or ""
            spans = base_spans(text, raw, int(longest[d]))
            low, high = int(at[d]), int(at[d + 1])
            if emissions is not None and high > low:
                own = emissions[low:high]
                for a, b in crf.windows(own, model.moves):
                    tags = crf.viterbi(own[a:b], model.moves)
                    for s, e in _found(tags):
                        x, y = int(starts[low + a + s] - bounds[d]), int(ends[low + a + e - 1] - bounds[d])
                        word = raw[x:y].rstrip(b".=")
                        x = len(raw[:x].decode("utf-8", "ignore"))
                        y = x + len(word.decode("utf-8", "ignore"))
                        if y > x and all(y <= p or x >= q for p, q, _ in spans):
                            spans.append((x, y, "crf"))
                spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
            out.append(spans)
    return out


def _found(tags: np.ndarray) -> Iterator[tuple[int, int]]:
    start = None
    for i, t in enumerate([*tags.tolist(), crf.OUT]):
        if start is not None and t != crf.INSIDE:
            yield start, i
            start = None
        if t == crf.BEGIN:
            start = i


_ALPHABETS = ("abcdef0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "abcdefghijklmnopqrstuvwxyz0123456789_-")


def _lookalike(rng: np.random.Generator) -> str:
    """Something long and mixed that is no secret."""

    def of(letters: str, n: int) -> str:
        return "".join(rng.choice(list(letters), n))

    lower, digits, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    word = lambda: of(lower, int(rng.integers(3, 12)))
    made = (
        lambda: f"https://{word()}.{word()}.org/{word()}/{word()}-{of(digits, 4)}",
        lambda: f"http://www.{word()}.com/{word()}?{word()}={of(digits, 3)}",
        lambda: f"//{word()}.com/{word()}/{word()}/{of(hexa, 7)}",
        lambda: "-".join(of(hexa, n) for n in (8, 4, 4, 4, 12)),
        lambda: ".".join(str(int(x)) for x in rng.integers(1, 255, 4)),
        lambda: f"20{of(digits, 2)}-0{int(rng.integers(1, 10))}-1{of(digits, 1)}T1{of(digits, 1)}:{of('012345', 1)}{of(digits, 1)}:00Z",
        lambda: f"/{word()}/{word()}/{word()}_{of(digits, 3)}.{of(lower, 3)}",
        lambda: "".join(word().capitalize() for _ in range(4)),
        lambda: "_".join(word() for _ in range(4)),
        lambda: f"{word()}.{word()}@{word()}.net",
        lambda: of(digits, int(rng.integers(8, 17))),
        lambda: word() + word() + word(),
    )
    return made[int(rng.integers(len(made)))]()


def _with_secrets(text: str, rng: np.random.Generator) -> tuple[str, list[tuple[int, int]], list[int]]:
    """A text with a few invented secrets and lookalikes between its words, where those are and where these start."""
    words = text.split(" ")
    out, spans, others, size = [], [], [], 0
    secrets, decoys = (set(rng.integers(0, len(words), n).tolist()) for n in (3, 4))
    for i, w in enumerate(words):
        if i in secrets:
            secret = "".join(rng.choice(list(_ALPHABETS[int(rng.integers(len(_ALPHABETS)))]), int(rng.integers(20, 48))))
            before = str(rng.choice(["", "key: ", "Bearer ", "auth=", "credential ", '"', "sk_live_"]))
            spans.append((size + len(before), size + len(before) + len(secret)))
            out.append(before + secret + ('"' if before == '"' else ""))
            size += len(out[-1]) + 1
        if i in decoys:
            others.append(size)
            out.append(_lookalike(rng))
            size += len(out[-1]) + 1
        out.append(w)
        size += len(w) + 1
    return " ".join(out), spans, others


def learn(texts: list[str], seed: int = 9) -> crf.Crf | None:
    """A field trained on texts, in their order."""
    rng = np.random.default_rng(seed)
    windows, tags = [], []
    for text in texts:
        if not text:
            continue
        found = [(s, e) for s, e, _ in base_spans(text, text.encode("utf-8", "surrogatepass"), 1 << 30)]
        for body, spans, others in ((text, found, []), _with_secrets(text, rng)):
            if spans is not found:
                spans = spans + [(s, e) for s, e, _ in base_spans(body, body.encode("utf-8", "surrogatepass"), 1 << 30)]
            raw = body.encode("utf-8", "surrogatepass")
            buffer, _, starts, ends, doc = _parsed([raw])
            if not len(starts):
                continue
            label = np.zeros(len(starts), dtype=np.int64)
            points = np.concatenate(([0], np.cumsum((buffer & 0xC0) != 0x80)))
            for s, e in spans:
                inside = np.flatnonzero((points[starts] < e) & (points[ends] > s) & (_CLASS[buffer[starts]] == 1))
                # of an assignment, its value
                inside = inside[-1:] if len(inside) > 1 and spans is found else inside
                label[inside] = crf.INSIDE
                label[inside[:1]] = crf.BEGIN
            features = describe(buffer, starts, ends, doc, 1)
            about = np.flatnonzero(label)
            about = rng.choice(about, ABOUT, replace=False) if len(about) > ABOUT else about
            near = np.searchsorted(points[starts], others)[:ELSEWHERE]
            for c in np.concatenate((about, near, rng.integers(0, len(label), ELSEWHERE))).clip(0, len(label) - 1).astype(int).tolist():
                low, high = max(0, c - AROUND), min(len(label), c + AROUND + 1)
                windows.append(features[low:high])
                tags.append(label[low:high].copy())
                if tags[-1][0] == crf.INSIDE:
                    tags[-1][0] = crf.BEGIN
    if not windows:
        return None
    t = 2 * AROUND + 1
    n = np.array([len(w) for w in windows])
    x = np.stack([np.pad(w, ((0, t - len(w)), (0, 0)), mode="edge") for w in windows])
    y = np.stack([np.pad(w, (0, t - len(w))) for w in tags])
    return crf.fit(x, y, n, SIZE)


def train(docs: DataFrame, drawn: int = DRAWN, seed: int = 9) -> crf.Crf | None:
    """Trains on at most WITH_FIND + WITHOUT_FIND documents of about ``drawn`` that a hash picks.

    The hashes of the drawn documents go to the driver, and then the texts of
    those that are trained on.
    """
    n = docs.count()
    if not n:
        return None
    rows = docs.select(F.col("text").cast("string").alias("text"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    find = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
    some = rows.filter(F.shiftrightunsigned("h", 11) / float(1 << 53) < drawn / n)
    found = sorted(some.select("h", F.coalesce(F.col("text").rlike(find), F.lit(False)).alias("has")).distinct().collect())
    kept = [h for has, most in ((True, WITH_FIND), (False, WITHOUT_FIND)) for h in [r["h"] for r in found if r["has"] == has][:most]]
    order = {h: i for i, h in enumerate(kept)}
    texts = {order[r["h"]]: r["text"] for r in rows.filter(F.col("h").isin(kept)).dropDuplicates(["h"]).collect()}
    return learn([texts[i] for i in sorted(texts)], seed)


def find_secrets(docs: DataFrame, model: crf.Crf | None) -> DataFrame:
    """``docs`` with secrets, an array of (start, end, kind) in code points by start."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<start:bigint,end:bigint,kind:string>>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found = scan([t if isinstance(t, str) else None for t in texts], held.value)
            yield pd.Series([[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in found])

    kept = [c for c in docs.columns if c != "secrets"]
    return docs.select(*kept, spans(F.col("text").cast("string")).alias("secrets"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans."""
    base = F.filter("secrets", lambda s: s["kind"] != "crf")

    def joined(items):
        return F.array_join(F.transform(items, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")

    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in PATTERNS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
