"""Language identification with Kneser-Ney character models.

Spark counts the character 4-grams of every training text by language. From
the counts each language gets an interpolated Kneser-Ney model: the highest
order uses counts, lower orders the number of different characters a gram
follows. All models share sorted arrays of gram codes, one per order, with a
column of log-probabilities per language, so one search serves every language.
A text gets the language of lowest cross-entropy per character.

No gram is left out. Counts, continuation counts and smoothing are Spark jobs,
an order at a time; the sorted arrays are files that every executor gets and
tasks map into memory, so disks and not memories hold the model.
"""

from __future__ import annotations

import os
import tempfile
import unicodedata
import uuid
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from ..session import ship_package
from .arrays import U64, pieces
from .native import stored

ORDER = 4
BITS = 16  # bits per character of a gram's code; characters beyond share codes modulo 2^16
PIECE = 2 << 20
PACK = 1 << 18  # rows of counts that are smoothed at once
DISCOUNT = 0.75
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)]))
    return _LETTERS[0]


def _normal(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the lower-cased letters with one space between words, and each text's bounds.

    A text with letters begins with ``ORDER - 1`` spaces and ends with one.
    """
    points = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = np.array([len(p) for p in points], np.int64)
    every = np.concatenate(points) if points else np.zeros(0, "<u4")
    letter = _letters()[every]
    # A break stands before the first letter of a word; each text's first word has more of them.
    owner = np.repeat(np.arange(len(points)), sizes)
    begins = letter.copy()
    begins[1:] &= ~letter[:-1] | (owner[1:] != owner[:-1])
    at, owner, starts = every[letter], owner[letter], begins[letter]
    first = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, bool)
    width = 1 + starts.astype(np.int64) + (ORDER - 2) * first
    ends = np.flatnonzero(np.append(first[1:], True)) if len(owner) else np.zeros(0, np.int64)
    width[ends] += 1  # room for the last space
    place = np.cumsum(width) - width
    out = np.full(int(width.sum()), 0x20, np.uint64)
    out[place + starts + (ORDER - 2) * first] = at & ((1 << BITS) - 1)
    totals = np.bincount(owner, weights=width, minlength=len(points)).astype(np.int64)
    return out, np.concatenate(([0], np.cumsum(totals)))


def _grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all 4-grams, and bounds of each text's part."""
    chars, bounds = _normal(texts)
    n = len(chars) - ORDER + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64)
    codes = np.zeros(n, U64)
    for k in range(ORDER):
        codes = (codes << U64(BITS)) | chars[k:k + n]
    inside = np.ones(n, bool)
    for k in range(1, ORDER):
        cuts = bounds[1:-1] - k
        inside[cuts[(cuts >= 0) & (cuts < n)]] = False
    sizes = np.maximum(np.diff(bounds) - ORDER + 1, 0)
    return codes[inside], np.concatenate(([0], np.cumsum(sizes)))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[at], np.add.reduceat(counts, at)


def _counted(batches, most: int = 1 << 20):
    """Gram counts of a task's texts, added up before they are sent; ``most`` bounds what a task holds."""
    held: dict[str, list] = {}

    def flush():
        for lang, parts in held.items():
            codes, counts = _merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.view(np.int64)),
                                              pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for piece in pieces(batch, "text", PIECE):
            langs = np.array(piece.column("lang").to_pylist(), object)
            texts = np.array(piece.column("text").to_pylist(), object)
            for lang in np.unique(langs):
                codes, _ = _grams(texts[langs == lang].tolist())
                if len(codes):
                    codes.sort()
                    at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
                    held.setdefault(lang, []).append((codes[at], np.diff(np.append(at, len(codes)))))
            if sum(len(c) for parts in held.values() for c, _ in parts) > most:
                held.update({lang: [_merge(parts)] for lang, parts in held.items()})
                if sum(len(parts[0][0]) for parts in held.values()) > most // 2:
                    yield from flush()
    yield from flush()


def count_grams(training: DataFrame) -> DataFrame:
    """``lang, gram, n`` over all rows of ``lang, text``; the gram is its 64-bit code."""
    ship_package(training.sparkSession)
    return (training.select("lang", "text").mapInArrow(_counted, "lang string, gram bigint, n bigint")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


ARRAYS = ("grams", "logs", "contexts", "backoffs")
_OPENED: dict[str, dict[str, np.ndarray]] = {}


@dataclass
class Model:
    """Log-probabilities of all languages; ``grams[n]`` are the sorted codes of order n.

    The arrays of a fitted model are in files; ``files[n]`` is the name of those of order n.
    """

    langs: list[str]
    grams: dict[int, np.ndarray] = field(default_factory=dict)
    logs: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, np.ndarray] = field(default_factory=dict)
    backoffs: dict[int, np.ndarray] = field(default_factory=dict)
    unknown: float = 0.0
    limits: np.ndarray | None = None
    sharpness: float = 1.0
    files: dict[int, str] = field(default_factory=dict)

    def opened(self) -> Model:
        """The model with the arrays of its files, mapped into memory."""
        if not self.files:
            return self
        orders = {}
        for order, name in self.files.items():
            if name not in _OPENED:
                if len(_OPENED) >= 2 * ORDER:
                    _OPENED.clear()
                _OPENED[name] = {a: np.asarray(np.load(SparkFiles.get(f"{name}-{a}.npy"), mmap_mode="r")) for a in ARRAYS}
            orders[order] = _OPENED[name]
        return replace(self, files={}, **{a: {n: arrays[a] for n, arrays in orders.items()} for a in ARRAYS})

    def score(self, codes: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log-probabilities of grams in every language: one row per code."""
        if order == 0:
            return np.full((len(codes), len(self.langs)), self.unknown, np.float32)
        at, found = _find(self.grams[order], codes)
        out = np.empty((len(codes), len(self.langs)), np.float32)
        out[found] = self.logs[order][at[found]]
        rest = ~found
        if rest.any():
            lower = self.score(codes[rest] & U64((1 << (BITS * (order - 1))) - 1), order - 1)
            ctx, known = _find(self.contexts[order], codes[rest] >> U64(BITS))
            lower[known] += self.backoffs[order][ctx[known]]
            out[rest] = lower
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def kneser_ney(langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """Interpolated models from counts: ``lang`` numbers, codes and counts of the highest order."""
    model = Model(langs)
    keys, row = np.unique(gram, return_inverse=True)
    counts = np.zeros((len(keys), len(langs)))
    np.add.at(counts, (row, lang), n)
    levels = {ORDER: (keys, counts)}
    for order in range(ORDER - 1, 0, -1):
        # A lower order counts how many characters a gram follows.
        above, used = levels[order + 1]
        keys, row = np.unique(above & U64((1 << (BITS * order)) - 1), return_inverse=True)
        counts = np.zeros((len(keys), len(langs)))
        np.add.at(counts, row, (used > 0).astype(float))
        levels[order] = (keys, counts)
    lower = None
    model.unknown = float(-np.log(len(levels[1][0]) + 1))
    for order in range(1, ORDER + 1):
        keys, counts = levels[order]
        if order == 1:
            below = np.full(counts.shape, np.exp(model.unknown))
        else:
            below = lower[_find(levels[order - 1][0], keys & U64((1 << (BITS * (order - 1))) - 1))[0]]
        lower, contexts, gamma = _smoothed(keys, counts, below)
        model.grams[order], model.contexts[order] = keys, contexts
        model.logs[order], model.backoffs[order] = _logs(lower, gamma)
    return model


def _smoothed(keys: np.ndarray, counts: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities of sorted grams from all counts of their contexts and the lower order's; the contexts and their shares for it."""
    contexts, row = np.unique(keys >> U64(BITS), return_inverse=True)
    total, kinds = np.zeros((len(contexts), counts.shape[1])), np.zeros((len(contexts), counts.shape[1]))
    np.add.at(total, row, counts)
    np.add.at(kinds, row, (counts > 0).astype(float))
    gamma = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
    return np.maximum(counts - DISCOUNT, 0) / np.maximum(total[row], 1) + gamma[row] * below, contexts, gamma


def _logs(probability: np.ndarray, gamma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.log(probability).astype(np.float32), np.log(np.maximum(gamma, 1e-12)).astype(np.float32)


def _packed(batches, order: int, model: Model, most: int):
    """Rows of the arrays of whole contexts; counts come sorted by gram, ``model`` has the lower orders."""
    model = model.opened()
    held = [np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)]

    def row(gram, number, n):
        keys, at = np.unique(gram, return_inverse=True)
        counts = np.zeros((len(keys), len(model.langs)))
        counts[at, number] = n
        below = np.exp(model.score(keys & U64((1 << (BITS * (order - 1))) - 1), order - 1).astype(np.float64))
        probability, contexts, gamma = _smoothed(keys, counts, below)
        logs, backoffs = _logs(probability, gamma)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys[:1].view(np.int64)), pa.array([len(keys)], pa.int64()), pa.array([len(contexts)], pa.int64()),
             *[pa.array([x.tobytes()], pa.binary()) for x in (keys, logs, contexts, backoffs)]],
            names=["first", "n", "m", *ARRAYS])

    for batch in batches:
        new = (np.asarray(batch.column("gram")).view(U64), np.asarray(batch.column("number")), np.asarray(batch.column("n")))
        held = [np.concatenate(x) for x in zip(held, new)]
        if len(held[0]) > most:
            contexts = held[0] >> U64(BITS)
            cut = int(np.searchsorted(contexts, contexts[-1]))
            if cut:
                yield row(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
    if len(held[0]):
        yield row(*held)


def _to_files(packed: DataFrame, langs: int) -> str:
    """Put the packed rows in order into one file an array, send the files to all executors, and name them.

    The driver holds a row at a time. The files stay until the application ends.
    """
    heads = sorted((r.first & (1 << 64) - 1, r.n, r.m) for r in packed.select("first", "n", "m").toLocalIterator())
    firsts, sizes = [h[0] for h in heads], np.array([h[1:] for h in heads], np.int64).reshape(-1, 2)
    ends = np.cumsum(sizes, axis=0)
    at = {f: (e - s).tolist() for f, e, s in zip(firsts, ends, sizes)}
    folder, name = tempfile.mkdtemp(prefix="answerscope-"), f"kneser-ney-{uuid.uuid4().hex}"
    shapes = {a: (np.float32 if a in ("logs", "backoffs") else U64, int(ends[-1, int(a in ("contexts", "backoffs"))])) for a in ARRAYS}
    paths = {a: os.path.join(folder, f"{name}-{a}.npy") for a in ARRAYS}
    out = {a: np.lib.format.open_memmap(paths[a], "w+", kind, (n, langs) if kind is np.float32 else (n,)) for a, (kind, n) in shapes.items()}
    for r in packed.toLocalIterator():
        for a in ARRAYS:
            values = np.frombuffer(r[a], out[a].dtype).reshape(-1, *out[a].shape[1:])
            begin = at[r.first & (1 << 64) - 1][a in ("contexts", "backoffs")]
            out[a][begin:begin + len(values)] = values
    for a in ARRAYS:
        out[a].flush()
        packed.sparkSession.sparkContext.addFile(paths[a])
    return name


def kneser_ney_files(counts: DataFrame) -> Model:
    """The models of ``kneser_ney`` from a table ``lang, gram, n``, as files; no step holds them whole."""
    langs = sorted(r.lang for r in counts.select("lang").distinct().toLocalIterator())
    if not langs:
        return Model([])
    levels = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (BITS * order)) - 1)).alias("gram")
        levels[order] = stored(levels[order + 1].groupBy("lang", shorter).agg(F.count(F.lit(1)).alias("n")), f"gram-counts-{order}")
    model = Model(langs, unknown=float(-np.log(levels[1].select("gram").distinct().count() + 1)))
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) - 1
    most = max(1024, PACK // len(langs))
    for order in range(1, ORDER + 1):
        # In the order of unsigned numbers; a context is whole in one partition.
        rows = levels[order].select("gram", number.cast("bigint").alias("number"), "n", F.shiftrightunsigned("gram", BITS).alias("_context"))
        rows = rows.repartitionByRange("_context").sortWithinPartitions("_context", F.col("gram").bitwiseAND(F.lit((1 << BITS) - 1)))
        packed = rows.select("gram", "number", "n").mapInArrow(
            lambda b, order=order, model=replace(model, files=dict(model.files)): _packed(b, order, model, most),
            "first bigint, n bigint, m bigint, " + ", ".join(f"{a} binary" for a in ARRAYS))
        model.files[order] = _to_files(stored(packed, f"kneser-ney-{order}"), len(langs))
    return model


def cross_entropies(model: Model, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Mean negative log-probability per character and language, and which texts have a letter."""
    codes, bounds = _grams(texts)
    some = np.diff(bounds) > 0
    out = np.zeros((len(texts), len(model.langs)))
    if len(codes):
        kinds, inverse = np.unique(codes, return_inverse=True)
        logs = model.score(kinds)
        at = bounds[:-1][some]
        for k in range(len(model.langs)):
            out[some, k] = -np.add.reduceat(logs[inverse, k].astype(np.float64), at) / np.diff(bounds)[some]
    return out, some


def fit(docs: DataFrame, calibration_rows: int = 5_000, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Count all training rows and build the models of all their grams.

    Training rows have a language, and a key whose CRC-32 is not 2 modulo 4.
    Rejection limits and the sharpness of the score are set on about
    ``calibration_rows`` training rows, chosen by a hash of the key.
    """
    training = (docs.where(F.col(lang).isNotNull() & (F.crc32(F.col(key).cast("string").cast("binary")) % 4 != 2))
                .select(F.col(key).alias("key"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")))
    model = kneser_ney_files(stored(count_grams(training), "gram-counts"))
    if not model.langs:
        return model
    rows = training.select("key").count()
    share = min(1.0, calibration_rows / max(rows, 1))
    chosen = training.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    known = score_table(chosen, model, "text", ["lang"]).select("lang", "entropies").where(F.size("entropies") > 0).toArrow()
    return calibrate(model, known.column("lang").to_pylist(), known.column("entropies").to_pylist())


def calibrate(model: Model, lang: list[str], entropies: list) -> Model:
    """Limits of four deviations above a language's mean, and the softmax sharpness of greatest likelihood."""
    values = np.array(entropies, float).reshape(-1, len(model.langs))
    truth = np.array([model.langs.index(x) if x in model.langs else -1 for x in lang], int)
    values, truth = values[truth >= 0], truth[truth >= 0]
    own = values[np.arange(len(truth)), truth]
    limits = [own[truth == k].mean() + 4 * own[truth == k].std() + 0.05 if (truth == k).any() else np.inf
              for k in range(len(model.langs))]
    model.limits = np.array(limits)
    best = -np.inf
    for sharpness in (1.0, 2.0, 5.0, 10.0, 20.0, 40.0):
        z = -sharpness * (values - values.min(1, keepdims=True)) if len(values) else values
        likelihood = (z[np.arange(len(truth)), truth] - np.log(np.exp(z).sum(1))).mean() if len(values) else 0.0
        if likelihood > best:
            best, model.sharpness = likelihood, sharpness
    return model


def score_table(docs: DataFrame, model: Model, text: str, columns: list[str]) -> DataFrame:
    """The columns with ``entropies``: one per language, in the model's order, empty without a letter."""
    ship_package(docs.sparkSession)
    schema = StructType([docs.schema[c] for c in columns]).add("entropies", ArrayType(DoubleType()))

    def scored(batches):
        own = model.opened()
        for batch in batches:
            for piece in pieces(batch, "_text", PIECE):
                values, some = cross_entropies(own, piece.column("_text").to_pylist())
                lists = [v.tolist() if s else [] for v, s in zip(values, some)]
                yield pa.RecordBatch.from_arrays([*[piece.column(c) for c in columns], pa.array(lists, pa.list_(pa.float64()))],
                                                 names=[*columns, "entropies"])

    return docs.select(*columns, F.col(text).alias("_text")).mapInArrow(scored, schema)


def identify(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Returns the key, ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``.

    The prediction uses the text alone. ``score`` is the share of the best
    language in a softmax over the entropies, ``rejected`` says that even the
    best is above its limit (the language stays). A null text or one without a
    letter, and every text if nothing was learned, is ``und`` with score 0 and
    no entropy, and rejected. On a tie the first language in the order of
    names wins. Repeated rows and rows without a key are rows like any other;
    the whole of a text is scored, however long.
    """
    if not model.langs:
        return docs.select(key, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"),
                           F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    found = F.size("entropies") > 0
    least = F.array_min("entropies")
    number = F.array_position("entropies", least).cast("int")
    share = 1 / F.aggregate("entropies", F.lit(0.0), lambda a, e: a + F.exp(-model.sharpness * (e - least)))
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), number - 1)
    return score_table(docs, model, text, [key]).select(
        key, F.when(found, pick(model.langs)).otherwise("und").alias("lang_pred"),
        F.when(found, share).otherwise(0.0).alias("score"), F.when(found, least).alias("cross_entropy"),
        F.when(found, least > pick([float(x) for x in model.limits])).otherwise(True).alias("rejected"))
