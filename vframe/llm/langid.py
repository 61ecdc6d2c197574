"""Language identification by string kernels.

Texts are compared by the blended spectrum of their distinct character runs
of one to three letters: the kernel of two texts is the number of runs they
share over the geometric mean of the runs they have. Landmarks from the
training sample span the Nystrom approximation; one ridge regression for each
language against the rest is solved in that space. A batch is scored by two
matrix products: presence by landmarks, and kernel values by languages.

The runs are those of the landmarks; everything but letters is a gap. Runs of
the ``LETTERS`` most common letters of the sample have numbers of their own,
those with any other letter are hashed into ``RARE`` numbers beyond them.

A score only says which language is nearest, and the nearest of n languages
has about 1/n or more for any text. Whether a text is like a language at all
is told by the share of its three-letter runs, repeats counted, that the
landmarks hold: none for a foreign alphabet, few for gibberish. The least
share of a language is ``LEAST_PART`` of what its labelled rows have, each
row measured against the other landmarks.

Defined cases: a null text or one without a letter is ``und`` with score 0;
rows without text, letter or language teach nothing; without any labelled
text all is ``und``; ties go to the language first by code point; an empty
table gives an empty result; all columns are kept and those of the
prediction's names replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vframe.llm.shingles import mix

#: Bound of the labelled rows that are fitted on, and of the landmarks among them.
TRAIN_ROWS, LANDMARKS = 1600, 192
LETTERS = 96
RARE = 1 << 22
RIDGE = 1e-3
#: A language's least share is so much of this quantile of its labelled rows.
LEAST_PART, LEAST_QUANTILE = 0.5, 0.01
BATCH = 256


@cache
def lowered() -> np.ndarray:
    """Each code point's letter in lower case, 0 for a gap."""
    out = np.zeros(0x110000, dtype=np.int32)
    for c in map(chr, range(0x110000)):
        if c.isalpha():
            out[ord(c)] = ord(c.lower()[0])
    return out


def symbols(letters: str) -> np.ndarray:
    """Each code point's symbol: 0 for a gap, then the letters, then any other letter."""
    place = np.full(0x110000, len(letters) + 1, dtype=np.uint8)
    place[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
    place[0] = 0
    return place[lowered()]


@dataclass
class Model:
    letters: str
    langs: list[str]
    slot: np.ndarray  #: of each run's code, its column or -1
    landmarks: np.ndarray  #: runs x landmarks, normalised
    coefficients: np.ndarray  #: landmarks + 1 x languages
    least: np.ndarray  #: of each language, the least share of runs held


def codes(text: str, table: np.ndarray, base: int) -> np.ndarray | None:
    """Codes of all runs of a text; None without a letter."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    s = table[points]
    if not s.any():
        return None
    s = np.concatenate(([0], s, [0])).astype(np.int32)
    kept = np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))
    s = s[kept]
    two = s[:-1] * base + s[1:]
    three = two[:-1] * base + s[2:]
    out = np.concatenate((s, base + two, base + base * base + three))
    rare = s == base - 1
    if rare.any():
        x = np.concatenate(([0], lowered()[points], [0]))[kept].astype(np.uint64) + np.uint64(1)
        two = (x[:-1] << np.uint64(21)) + x[1:]
        three = (two[:-1] << np.uint64(21)) + x[2:]
        at = np.flatnonzero(np.concatenate((rare, rare[:-1] | rare[1:], rare[:-2] | rare[1:-1] | rare[2:])))
        hashed = mix(np.concatenate((x, two, three))[at]) >> np.uint64(65 - RARE.bit_length())
        out[at] = base + base**2 + base**3 + hashed.astype(np.int32)
    return out


def _threes(x: np.ndarray) -> np.ndarray:
    """Of values by run, as ``codes`` orders them, those of three-letter runs."""
    return x[2 * len(x) // 3 + 1 :]


def _distinct(found: np.ndarray, place: np.ndarray) -> int:
    """How many distinct runs a text has; ``place`` is scratch with an entry for each run there can be."""
    order = np.arange(len(found), dtype=place.dtype)
    place[found] = order
    return int((place[found] == order).sum())


def fit(texts: list[str], langs: list[str], landmarks: int = LANDMARKS) -> Model:
    """A model of labelled texts, each with a letter; deterministic in their order."""
    names = sorted(set(langs))
    seen: dict[str, int] = {}
    for t in texts:
        for c in set(t.lower()):
            if c.isalpha():
                seen[c] = seen.get(c, 0) + 1
    letters = "".join(sorted(sorted(seen, key=lambda c: (-seen[c], c))[:LETTERS]))
    table, base = symbols(letters), len(letters) + 2
    whole = [codes(t, table, base) for t in texts]
    found = [np.unique(x) for x in whole]
    by = {g: [i for i, x in enumerate(langs) if x == g] for g in names}
    chosen: list[int] = []
    for turn in range(max(map(len, by.values()), default=0)):
        chosen += [by[g][turn] for g in names if turn < len(by[g])]
    chosen = chosen[: max(landmarks, len(names))]
    runs = np.unique(np.concatenate([found[i] for i in chosen])) if chosen else np.zeros(0, np.int32)
    slot = np.full(base + base**2 + base**3 + RARE, -1, dtype=np.int32)
    slot[runs] = np.arange(len(runs))
    presence = np.zeros((len(texts), len(runs)), dtype=np.float32)
    for i, x in enumerate(found):
        at = slot[x]
        presence[i, at[at >= 0]] = 1
    presence /= np.sqrt([[len(x)] for x in found]).astype(np.float32)
    marks = presence[chosen].T.copy()
    holders = np.append((marks > 0).sum(axis=1), 0)  # the last for runs of no column
    own = np.isin(np.arange(len(texts)), chosen)
    share = np.array([(holders[slot[_threes(x)]] > own[i]).mean() for i, x in enumerate(whole)])
    least = np.array([LEAST_PART * np.quantile(share[by[g]], LEAST_QUANTILE) for g in names])
    kernel = presence @ marks
    values, vectors = np.linalg.eigh(kernel[chosen].astype(np.float64))
    ok = values > 1e-6 * max(values.max(initial=0), 1e-12)
    root = vectors[:, ok] / np.sqrt(values[ok])
    features = np.column_stack((kernel @ root, np.ones(len(texts))))
    goal = np.array([[1.0 if x == g else -1.0 for g in names] for x in langs]).reshape(len(texts), len(names))
    weight = np.array([1 / len(by[x]) for x in langs])[:, None]  # languages count alike
    gram = features.T @ (weight * features) + RIDGE * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, features.T @ (weight * goal))
    return Model(letters, names, slot, marks, np.vstack((root @ solved[:-1], solved[-1:])).astype(np.float32), least)


_TABLES: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Languages and scores of texts."""
    return judge(model, texts)[:2]


def judge(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages and scores of texts, and whether each is like its language.

    Of a short text's share, two standard deviations are forgiven; a text
    none of whose letters a landmark has is never alike.
    """
    if model.letters not in _TABLES:
        _TABLES[model.letters] = symbols(model.letters), np.zeros(len(model.slot), dtype=np.int32)
    (table, place), base = _TABLES[model.letters], len(model.letters) + 2
    langs, scores, alike = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
    if not model.langs:
        return langs, scores, alike
    # texts are taken so many at a time that their matrix is bounded
    step = max(8, min(BATCH, (1 << 24) // max(1, model.landmarks.shape[0])))
    for i in range(0, len(texts), step):
        part = texts[i : i + step]
        presence, rows, shares, own = np.zeros((len(part), model.landmarks.shape[0]), dtype=np.float32), [], [], []
        for j, t in enumerate(part):
            found = codes(t, table, base) if t else None
            if found is not None:
                at = model.slot[found]
                presence[len(rows), at[at >= 0]] = 1
                rows.append(i + j)
                own.append([_distinct(found, place)])
                threes = _threes(at)
                letter = (at >= 0) & (found > 0)
                shares.append(((threes >= 0).mean() if letter[: len(threes) + 2].any() else -1.0, len(threes)))
        kernel = presence[: len(rows)] / np.sqrt(own or np.ones((0, 1))).astype(np.float32) @ model.landmarks
        values = kernel @ model.coefficients[:-1] + model.coefficients[-1]
        best = values.argmax(axis=1) if len(rows) else []
        for j, k in enumerate(best):
            langs[rows[j]], scores[rows[j]] = model.langs[k], min(1.0, max(0.0, (1 + float(values[j, k])) / 2))
            share, n = shares[j]
            least = model.least[k]
            alike[rows[j]] = share >= max(0.0, least - 2 * np.sqrt(least * (1 - least) / n))
    return langs, scores, alike


def train(labelled: DataFrame, rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS, seed: int = 5) -> Model:
    """Fits on at most ``rows`` of ``labelled`` (text, lang, and doc_id to draw by).

    Languages get equal places. Their counts, one row for each language, and
    the sample go to the driver; the sample's rows are drawn by a hash.
    """
    usable = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"))
    usable = usable.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = dict(usable.groupBy("lang").count().collect())
    if not counts:
        return Model("", [], np.zeros(0, np.int32), np.zeros((0, 0), np.float32), np.zeros((1, 0), np.float32), np.zeros(0))
    each = max(1, rows // len(counts))
    unit = F.shiftrightunsigned("h", 11) / float(1 << 53)
    limit = F.create_map(*(F.lit(x) for g, n in counts.items() for x in (g, min(1.0, (2.0 * each + 20) / n))))
    drawn = usable.filter(unit < F.element_at(limit, F.col("lang"))).collect()
    drawn.sort(key=lambda r: (r["h"], r["lang"], r["text"]))
    left = dict.fromkeys(counts, each)
    kept = []
    for r in drawn:
        if left[r["lang"]] and any(map(str.isalpha, r["text"])):
            left[r["lang"]] -= 1
            kept.append(r)
    return fit([r["text"] for r in kept], [r["lang"] for r in kept], landmarks)


def scorer(spark: SparkSession, model: Model):
    """A column function of a text: struct of lang_pred, score and alike."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, alike boolean")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            langs, scores, alike = judge(held.value, [t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang_pred": langs, "score": scores, "alike": alike})

    return lambda text: score(text.cast("string"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    found = scorer(docs.sparkSession, model)(F.col("text"))
    return docs.select(*kept, found["lang_pred"].alias("lang_pred"), found["score"].alias("score"))


def keep_known(docs: DataFrame, model: Model, least: float = 0.2) -> DataFrame:
    """The documents like one of the languages, with a score of ``least`` or more.

    Where no language was learned, those with a letter.
    """
    if not model.langs:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = scorer(docs.sparkSession, model)(F.col("text"))
    return docs.filter((found["lang_pred"] != "und") & (found["score"] >= least) & found["alike"])
