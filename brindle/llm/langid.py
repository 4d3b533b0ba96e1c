"""Language ID by hyperdimensional profiles.

Every letter has a random vector of signs. An n-gram is the product (binding) of its letters'
vectors, each rotated (permuted) by its distance from the end; a text is the sum (bundle) of its
n-grams' vectors, and a language's prototype is the bundle of all texts labelled with it. A text gets the
language whose prototype is nearest by cosine.

Texts are cut into words of letters, lower-cased, a blank on each side; an n-gram never holds two
blanks in a row. Bundles are sums, so training counts n-grams first: a task counts them for each
language over all its rows, turns the counts into one vector for each language, and Spark adds the
vectors up, dimension by dimension. All labelled rows take part.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.work import bounded_batches, table

DIMENSIONS = 512
NGRAM = 3
SEED = 23
#: Every FOLDS-th document, by checksum of its id, is held out of training.
FOLDS = 5
UNDETERMINED = "und"
#: What stands between texts that are counted together; the middle is their END.
BETWEEN = " \n "
END = (1 << 21) - 1
#: Least cosine with the nearest prototype that a filter takes for a language.
LEAST_SCORE = 0.05
#: A language's dimension sums are kept for at most this many languages; more are an error.
MOST_LANGUAGES = 4096
#: Characters that are counted at a time when training (one text may be longer).
STEP_CHARS = 1 << 20
#: Texts, and n-grams of texts, that are judged at a time.
STEP_TEXTS, STEP_GRAMS = 64, 20_000
#: Most different n-grams whose vectors a task remembers.
MOST_GRAMS = 100_000

_letters = None


def letters() -> np.ndarray:
    """For each code point its lower-case letter's code point, or 0 if it is no letter. Letters whose lower case is several characters keep the first."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((ord(chr(i).lower()[0]) if unicodedata.category(chr(i))[0] == "L" else 0 for i in range(sys.maxunicode + 1)), np.int64, sys.maxunicode + 1)
    return _letters


def grams(text: str, n: int = NGRAM, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """The different n-grams of a text as rows of letters (0 is the blank), and their counts; None without letters.

    ends: places in the text, with a blank on each side, that no n-gram goes over.
    """
    codes = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    if not codes.any():
        return None
    if ends is not None:
        codes[ends] = END
    codes = np.concatenate([[0], codes, [0]])
    codes = codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]
    used, small = np.unique(codes, return_inverse=True)
    key = np.zeros(max(0, len(small) - n + 1), np.int64)
    for i in range(n):
        key = key * len(used) + small[i : len(small) - n + 1 + i]
    size = len(used) ** n
    if size <= max(1 << 17, 4 * len(key)):
        counts = np.bincount(key, minlength=1)
        found = np.flatnonzero(counts)
        counts = counts[found]
    else:
        found, counts = np.unique(key, return_counts=True)
    rows = np.empty((len(found), n), np.int64)
    for i in range(n - 1, -1, -1):
        rows[:, i] = used[found % len(used)]
        found = found // len(used)
    if ends is not None:
        whole = (rows != END).all(1)
        rows, counts = rows[whole], counts[whole]
    return rows, counts


class Vectors:
    """Letter and n-gram vectors, the same in every task; a task's own, so that a worker keeps nothing of them."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.letter: dict[int, np.ndarray] = {}
        self.known: dict[int, tuple] = {}

    def of_letter(self, code: int) -> np.ndarray:
        if code not in self.letter:
            self.letter[code] = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions).astype(np.int8) * 2 - 1
        return self.letter[code]

    def _made(self, rows: np.ndarray) -> np.ndarray:
        out = np.ones((len(rows), self.dimensions), np.int8)
        for i in range(rows.shape[1]):
            used, which = np.unique(rows[:, i], return_inverse=True)
            out *= np.stack([np.roll(self.of_letter(c), rows.shape[1] - 1 - i) for c in used.tolist()])[which]
        return out

    def of_grams(self, rows: np.ndarray) -> np.ndarray:
        """Vectors of n-grams, one in a row: the product of the letters' vectors, each rotated by its distance from the last."""
        n = rows.shape[1]
        if n > 3:  # the key below holds three letters
            return self._made(rows)
        key = rows[:, 0]
        for i in range(1, n):
            key = key << 21 | rows[:, i]
        keys, table = self.known.get(n, (np.zeros(0, np.int64), np.zeros((0, self.dimensions), np.int8)))
        at = np.searchsorted(keys, key)
        new = np.ones(len(key), bool) if not len(keys) else keys[np.minimum(at, len(keys) - 1)] != key
        if new.any():
            if len(keys) > MOST_GRAMS:
                keys, table = keys[:0], table[:0]
                new[:] = True
            fresh, first = np.unique(key[new], return_index=True)
            keys, table = np.concatenate([keys, fresh]), np.concatenate([table, self._made(rows[new][first])])
            order = np.argsort(keys)
            keys, table = keys[order], table[order]
            self.known[n] = keys, table
            at = np.searchsorted(keys, key)
        return table[at]

    def bundles(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The bundle of each text, given by its n-grams and counts, as one product of counts and vectors."""
        rows = np.concatenate([r for r, _ in texts])
        found, first, which = _distinct(rows)
        counts = np.zeros((len(texts), found), np.float32)
        counts[np.repeat(np.arange(len(texts)), [len(r) for r, _ in texts]), which] = np.concatenate([c for _, c in texts])
        return counts @ self.of_grams(rows[first]).astype(np.float32)


def _distinct(rows: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """How many different rows there are, where each first stands, and which of them each row is."""
    if rows.shape[1] > 3:
        _, first, which = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        return len(first), first, which.reshape(-1)
    key = rows[:, 0]
    for i in range(1, rows.shape[1]):
        key = key << 21 | rows[:, i]
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    return len(first), first, which


def train(rows: DataFrame, dimensions: int = DIMENSIONS, n: int = NGRAM, seed: int = SEED) -> dict[str, np.ndarray]:
    """Prototypes from rows (text, lang): for each language the bundle of all its texts. Rows without a language or without letters add nothing."""

    def add(batches):
        total: dict[str, np.ndarray] = {}
        texts: dict[str, list] = {}
        v = Vectors(dimensions, seed)

        def count(lang):
            held = texts.pop(lang)
            sizes = np.fromiter(map(len, held[1]), np.int64, len(held[1])) + len(BETWEEN)
            found = grams(BETWEEN.join([*held[1], ""]), n, np.cumsum(sizes) - 2)
            if found:
                rows, counts = found
                own = total.setdefault(lang, np.zeros(dimensions, np.int64))
                for i in range(0, len(rows), 4096):
                    own += np.rint(counts[i : i + 4096].astype(np.float64) @ v.of_grams(rows[i : i + 4096])).astype(np.int64)

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1)):
                text, lang = text.as_py(), lang.as_py()
                if text and lang is not None:
                    held = texts.setdefault(lang, [0, []])
                    held[0] += len(text)
                    held[1].append(text)
                    if held[0] >= STEP_CHARS:
                        count(lang)
        for lang in list(texts):
            count(lang)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], names=["lang", "v"])

    bounded_batches(rows.sparkSession)
    parts = rows.select("text", "lang").mapInArrow(add, "lang string, v array<bigint>")
    sums = parts.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    if sums.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # one row for each language and dimension
        out.setdefault(r["lang"], np.zeros(dimensions))[r["at"]] = r["x"]
    return dict(sorted(out.items()))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS, n: int = NGRAM, seed: int = SEED, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in keep, lang_pred and score for each row of docs, from the whole text alone.

    score is the cosine with the nearest prototype, 0 at least; of equal ones the first language by
    code point wins. Without text or letters, or without prototypes, the language is ``und`` and the score 0.
    """
    bounded_batches(docs.sparkSession)
    names = list(prototypes)
    units = np.array([p / max(np.linalg.norm(p), 1e-300) for p in prototypes.values()]).reshape(-1, dimensions)

    columns = keep if text_col in keep else (*keep, text_col)
    at = columns.index(text_col)

    def run(batches):
        v = Vectors(dimensions, seed)
        for b in batches:
            lang, score = [UNDETERMINED] * b.num_rows, [0.0] * b.num_rows
            held, size = [], 0

            def judge():
                bundles = v.bundles([g for _, g in held]).astype(np.float64)
                norms = np.linalg.norm(bundles, axis=1)
                near = (bundles @ units.T) / np.maximum(norms, 1e-300)[:, None]
                for (i, _), best, cosines, norm in zip(held, near.argmax(1).tolist(), near, norms):
                    if norm:
                        lang[i], score[i] = names[best], float(min(1.0, max(0.0, cosines[best])))

            for i, text in enumerate(b.column(at)):
                found = grams(text.as_py() or "", n) if names else None
                if found is None or not len(found[0]):
                    continue
                held.append((i, found))
                size += len(found[0])
                if len(held) == STEP_TEXTS or size > STEP_GRAMS:
                    judge()
                    held, size = [], 0
            if held:
                judge()
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*keep, "lang_pred", "score"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double"])
    return docs.select(*columns).mapInArrow(run, schema)


def held_out(doc_id) -> object:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def identify_languages(docs: DataFrame, dimensions: int = DIMENSIONS, n: int = NGRAM, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, lang_pred, score, and the columns in keep.

    Trained on the texts with a language whose id is not held out (checksum of the id as text,
    modulo FOLDS, not 0; a null id is neither held out nor trained on). The label, the id and all other columns are never
    inputs of a prediction. See train and predict for nulls; repeated rows get equal predictions; an empty table an empty result.
    """
    fold = F.coalesce(held_out(F.col(id_col)), F.lit(False))
    trained = docs.where(F.col(id_col).isNotNull() & ~fold).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    prototypes = train(trained, dimensions, n, seed)
    marked = docs.select(F.col(id_col).alias("doc_id"), fold.alias("held_out"), *keep, F.col(text_col).alias("__text"))
    return predict(marked, prototypes, dimensions, n, seed, "__text", ("doc_id", "held_out", *keep))


def filter_languages(docs: DataFrame, least: float = LEAST_SCORE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of docs whose language can be told: those that get a language, with a cosine of at least ``least``. Columns and values stay as they are."""
    fold = F.coalesce(held_out(F.col(id_col)), F.lit(False))
    trained = docs.where(F.col(id_col).isNotNull() & ~fold).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    plain = tuple(f"c{i}" for i in range(len(docs.columns)))
    found = predict(docs.toDF(*plain), train(trained, **options), text_col=plain[docs.columns.index(text_col)], keep=plain, **options)
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select(*(F.col(c).alias(n) for c, n in zip(plain, docs.columns)))


def op8_language_id(spark, sf_dir):
    return identify_languages(table(spark, sf_dir, "documents"))
