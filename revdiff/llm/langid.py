"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import lean_batches, staged
from .textbatch import mix64, slices, text_buffer

DIMENSIONS, GRAM = 512, 3
#: Texts whose n-grams are bundled by one matrix product.
_TOGETHER = 48


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point: its lower case if it is a letter (one code point), else 0."""
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x41, 0x110000):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def letter_vectors(code: np.ndarray, dimensions: int) -> np.ndarray:
    """A fixed random vector of -1 and 1 for each code point; 0 stands for the gap between words."""
    seed = mix64(code.astype(np.uint64) + np.uint64(0x9E3779B9))
    words = mix64(seed[:, None] ^ mix64(np.arange(1, dimensions // 64 + 1, dtype=np.uint64))[None, :])
    bits = np.unpackbits(words.view(np.uint8).reshape(len(code), dimensions // 8), axis=1)
    return (bits.astype(np.int8) * 2 - 1)[:, :dimensions]


def gram_vectors(gram: np.ndarray, dimensions: int) -> np.ndarray:
    """n-gram vectors: the letters' vectors, each permuted (rolled) by its place, bound by multiplication."""
    out = np.ones((len(gram), dimensions), np.int8)
    for place in range(GRAM):
        code = (gram >> np.uint64(21 * place)) & np.uint64(0x1FFFFF)
        uniq, which = np.unique(code, return_inverse=True)
        out *= np.roll(letter_vectors(uniq, dimensions), place, axis=1)[which]
    return out


def _grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and n-gram of each window of letters, runs of other characters and both ends of a text being one gap; and the letters of each row."""
    n = len(offsets) - 1
    code = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offsets]
    if len(code) != at[-1]:  # not valid UTF-8: decode text by text
        parts = [np.frombuffer(buf[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offsets[:-1], offsets[1:])]
        code, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    letter = _letters()[code].astype(np.uint64)
    doc = np.repeat(np.arange(n), np.diff(at))
    count = np.bincount(doc, weights=letter > 0, minlength=n).astype(np.int64)
    padded = np.zeros(len(letter) + 2 * n, np.uint64)
    padded[np.arange(len(letter)) + 2 * doc + 1] = letter
    letter, doc = padded, np.repeat(np.arange(n), np.diff(at) + 2)
    keep = np.ones(len(letter), bool)
    keep[1:] = (letter[1:] != 0) | (letter[:-1] != 0) | (doc[1:] != doc[:-1])
    letter, doc = letter[keep], doc[keep]
    if len(letter) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), count
    m = len(letter) - GRAM + 1
    gram = np.zeros(m, np.uint64)
    for place in range(GRAM):
        gram |= letter[place : place + m] << np.uint64(21 * place)
    whole = doc[:m] == doc[GRAM - 1 :]
    return doc[:m][whole], gram[whole], count


def _numbered(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, and for each n-gram its place among them."""
    letters, small = [], np.zeros(len(gram), np.int64)
    for place in range(GRAM):
        code = ((gram >> np.uint64(21 * place)) & np.uint64(0x1FFFFF)).astype(np.int64)
        present = np.flatnonzero(np.bincount(code)) if len(code) else code
        number = np.zeros(0x110000, np.int32)
        number[present] = np.arange(len(present))
        small = small * len(present) + number[code]
        letters.append(present)
    size = int(np.prod([len(x) for x in letters]))
    if size > 1 << 24:  # many scripts at once
        return np.unique(gram, return_inverse=True)
    seen = np.zeros(size, bool)
    seen[small] = True
    some = np.flatnonzero(seen)
    number = np.zeros(size, np.int32)
    number[some] = np.arange(len(some))
    uniq, rest = np.zeros(len(some), np.uint64), some
    for place in range(GRAM - 1, -1, -1):
        rest, at = np.divmod(rest, len(letters[place]))
        uniq |= letters[place][at].astype(np.uint64) << np.uint64(21 * place)
    return uniq, number[small].astype(np.int64)


def profiles(buf: np.ndarray, offsets: np.ndarray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """The bundled vector of each text, of unit length (zero if it has no n-gram), and its number of letters."""
    n = len(offsets) - 1
    doc, gram, letters = _grams(buf, offsets)
    uniq, which = _numbered(gram)
    table = gram_vectors(uniq, dimensions).astype(np.float32)
    edge = np.searchsorted(doc, np.arange(n + 1))
    out = np.zeros((n, dimensions), np.float32)
    for lo in range(0, n, _TOGETHER):
        hi = min(lo + _TOGETHER, n)
        a, b = edge[lo], edge[hi]
        seen = np.zeros(len(uniq), bool)
        seen[which[a:b]] = True
        local = np.cumsum(seen) - 1
        k = int(seen.sum())
        count = np.bincount((doc[a:b] - lo) * k + local[which[a:b]], minlength=(hi - lo) * k).reshape(hi - lo, k)
        out[lo:hi] = count.astype(np.float32) @ table[seen]
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9), letters


def _learned(dimensions: int):
    """Sums of the profiles of each language in a partition, as (lang, part, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for lo, hi in slices(offsets):
                v, letters = profiles(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], dimensions)
                own = langs[lo:hi]
                for lang in set(own[letters > 0].tolist()):
                    some = v[(own == lang) & (letters > 0)].sum(axis=0, dtype=np.float64)
                    total[lang] = total.get(lang, 0) + np.append(some, ((own == lang) & (letters > 0)).sum())
        names = [x for x in total for _ in range(dimensions + 1)]
        cells = np.tile(np.arange(dimensions + 1, dtype=np.int32), len(total))
        values = np.concatenate(list(total.values())) if total else np.zeros(0)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(cells, pa.int32()), pa.array(values)], names=["lang", "cell", "value"])

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _prototypes(train: DataFrame, dimensions: int, together: int) -> list[Broadcast]:
    """Broadcast (languages by name, their centred prototypes, what all have in common), ``together`` languages or about as many at a time."""
    spark = train.sparkSession
    sums = staged(train.mapInArrow(_learned(dimensions), "lang string, cell int, value double").groupBy("lang", "cell").agg(F.sum("value").alias("value")))
    count = sums.select("lang").distinct().count()
    blocks = math.ceil(count / together)

    def block(b: int) -> tuple[list[str], np.ndarray]:
        table = sums.filter(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == b).toPandas()
        langs = sorted(table["lang"].unique())
        full = np.zeros((len(langs), dimensions + 1))
        full[table["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(int), table["cell"].to_numpy(int)] = table["value"].to_numpy(float)
        return langs, _unit(full[:, :-1])

    common = np.zeros(dimensions)
    for b in range(blocks if count > 1 else 0):
        common += block(b)[1].sum(axis=0) / count
    return [spark.sparkContext.broadcast((langs, _unit(own - common), common)) for langs, own in map(block, range(blocks)) if langs]


def _best(v: np.ndarray, letters: np.ndarray, model: tuple[list[str], np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each profile the nearest language and its score."""
    langs, proto, common = model
    cosine = _unit(v - common) @ proto.T
    best = cosine.argmax(axis=1)
    score = np.clip((1 + cosine[np.arange(len(v)), best]) / 2, 0, 1)
    names = np.array(langs, dtype=object)[best]
    names[letters == 0] = "und"
    score[letters == 0] = 0
    return names, score


def identify_languages(docs: DataFrame, *, dimensions: int = DIMENSIONS, together: int = 2000) -> DataFrame:
    """The language of each whole text, learned from the table's own ``lang``.

    ``docs`` needs ``doc_id, text, lang``; other columns are ignored. Learned from
    are the rows with a language whose crc32(doc_id as text) modulo 3 isn't 1; a
    prediction uses the text only. Returns a row per row of ``docs``: ``doc_id,
    held_out, lang_pred, score``.

    Letters (lower case) have fixed random vectors of -1 and 1; a run of other
    characters is a gap, and so is either end of a text. The vectors of three neighbours,
    permuted by their place, are multiplied to an n-gram vector; a text's profile is the
    sum of its n-gram vectors, of unit length, a language's prototype the sum of its
    texts' profiles. What all prototypes have in common is taken off both before the
    cosine; the score is half of 1 plus the cosine with the predicted language.

    Prototypes are summed within each partition and then in Spark. They are broadcast
    about ``together`` at a time; where there are more languages, profiles are written
    once, compared with each such block, and the best of all blocks counts. Null texts
    and texts without a letter give ``und`` and score 0, as does a table without any
    language to learn from; a text of one letter has one n-gram, the letter between gaps.
    Ties go to the first language by name. Null ids are predicted and not learned from;
    repeated rows count each time; an empty table gives no rows.
    """
    lean_batches(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    train = rows.filter(~held & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("lang", "text")
    models = _prototypes(train, dimensions, together)
    rows = rows.select("doc_id", held.alias("held_out"), "text")
    if not models:
        return rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if len(models) == 1:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                buf, offsets = text_buffer(batch.column(2))
                for lo, hi in slices(offsets):
                    names, score = _best(*profiles(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], dimensions), models[0].value)
                    ids = [batch.column(i).slice(lo, hi - lo) for i in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

        return rows.mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_buffer(batch.column(1))
            for lo, hi in slices(offsets):
                v, letters = profiles(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], dimensions)
                edges = pa.array(np.arange(hi - lo + 1, dtype=np.int32) * dimensions)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(letters), pa.ListArray.from_arrays(edges, pa.array(v.reshape(-1)))], names=["row", "letters", "v"])

    def compared(model: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, score = _best(batch.column(2).flatten().to_numpy().reshape(-1, dimensions), batch.column(1).to_numpy(), model.value)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["row", "lang_pred", "score"])

        return run

    numbered = staged(rows.withColumn("row", F.monotonically_increasing_id()))
    known = staged(numbered.select("row", "text").mapInArrow(profiled, "row bigint, letters bigint, v array<float>"))
    parts = functools.reduce(DataFrame.unionByName, [known.mapInArrow(compared(m), "row bigint, lang_pred string, score double") for m in models])
    best = parts.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("s"), "lang_pred")).alias("b"))
    return numbered.join(best, "row").select("doc_id", "held_out", F.col("b.lang_pred").alias("lang_pred"), (-F.col("b.s")).alias("score"))
