"""Language identification by interpolated Kneser-Ney character models.

Training counts the 4-grams of letters in words, with marks for a word's start and end, over all labelled rows given to it;
words are counted once per slice of text and weighted.  Lower orders count continuations, so they follow from the 4-grams.
The models of all languages share one sorted array of hashes for each order; under each hash lie the languages that have
the gram, with its log probability, or the context, with its backoff weight.  A text gets the language of least
cross-entropy per letter, and a confidence from a logistic regression of "right" on the margin to the second, the text's
length and the entropy itself, fitted on all rows set apart for it, which the models in use there haven't seen.  Rows below the least confidence
from which PRECISION of the rows set apart are right are rejected; the final models learn from all labelled rows.
The rows set apart stay a table: each step of the fit adds up what its tasks give, and the bound is sought in ranges of the confidence.

The model has every 4-gram of every language, about 12 bytes for each gram and language that has it; the driver and every executor hold it.
Texts are scored whole.

Nulls: a null text, or one without a letter, is `und` with score 0 and rejected; rows without a language teach nothing.  Ties go to
the first language by code point.  Repeated rows count each time.  Extra columns are not read.  Without any labelled
row everything is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import mix, run_hashes, slices
from .shared import partitions, table, written

ORDER = 4
#: Share of the rows set apart that must be right among those not rejected.
PRECISION = 0.99
#: Counts that a task holds before it sends them on.
GATHER = 1 << 20
#: Values of words that a worker keeps before it starts anew.
KEEP = 4 << 20
START, END = 2, 3
UND = "und"
#: Columns of what the confidence is learned from.
INPUTS = ("one", "a", "b", "c", "d")


@cache
def _letters() -> np.ndarray:
    """For each code point its lower-case form, 0 for what is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def code_points(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts that lie one after another, and where each begins."""
    data = text.tobytes()
    try:
        cps = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    except UnicodeDecodeError:
        parts = [np.frombuffer(data[a:b].decode(errors="replace").encode("utf-32-le"), np.uint32) for a, b in zip(at[:-1], at[1:], strict=True)]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    lead = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    return cps, lead[at]


def _words(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded letters, starts and lengths of words, and the document of each word."""
    cps, at = code_points(text, at)
    folded = _letters()[cps]
    inside = folded > 0
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = at[(at > 0) & (at < len(cps))]
    start[cut], end[cut - 1] = inside[cut], inside[cut - 1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return folded, start, end - start, np.searchsorted(at, start, "right") - 1


def _distinct(folded: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words in order, one occurrence of each, which of those every word is)."""
    key = run_hashes(lambda low, high: mix(folded[low:high].astype(np.uint64)), len(folded), start, start + size)
    return np.unique(key, return_index=True, return_inverse=True)


def _grams(folded: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A row of ORDER code points for each letter of each word, and for its end."""
    padded_size = size + ORDER
    first = np.cumsum(padded_size) - padded_size
    padded = np.full(int(padded_size.sum()), START, np.uint32)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    padded[np.repeat(first + ORDER - 1, size) + place] = folded[np.repeat(start, size) + place]
    padded[first + padded_size - 1] = END
    n = size + 1
    at = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
    return padded[at[:, None] + np.arange(ORDER)]


def hashes(grams: np.ndarray) -> np.ndarray:
    out = np.full(len(grams), np.uint64(grams.shape[1]))
    for j in range(grams.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + grams[:, j].astype(np.uint64))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, apart, gram, n) of rows (text, lang, apart): counts of a task, in pieces."""
    names: dict[tuple[str, bool], int] = {}
    held: list[tuple] = []

    def merged() -> tuple:
        lang, gram, n = (np.concatenate([h[i] for h in held]) for i in range(3))
        _, one, which = np.unique(hashes(gram) ^ mix(lang.astype(np.uint64) + np.uint64(1)), return_index=True, return_inverse=True)
        return lang[one], gram[one], np.bincount(which, n).astype(np.int64)

    def out() -> pa.RecordBatch:
        lang, gram, n = held[0]
        text = np.ascontiguousarray(gram).tobytes().decode("utf-32-le", "surrogatepass")
        of = list(names)
        return pa.RecordBatch.from_arrays([pa.array([of[x][0] for x in lang]), pa.array([of[x][1] for x in lang]), pa.array([text[i : i + ORDER] for i in range(0, len(text), ORDER)]), pa.array(n)], ["lang", "apart", "gram", "n"])

    for batch in batches:
        langs = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
        for first, end, text, at in slices(batch.column(0)):
            own = np.array([names.setdefault(x, len(names)) for x in langs[first:end]])
            folded, start, size, doc = _words(text, at)
            if not len(start):
                continue
            _, one, which = _distinct(folded, start, size)
            pair, times = np.unique(which * len(names) + own[doc], return_counts=True)
            word, lang = one[pair // len(names)], pair % len(names)
            gram = _grams(folded, start[word], size[word])
            n = size[word] + 1
            held.append((np.repeat(lang, n), gram, np.repeat(times, n)))
            held = [merged()]
            if len(held[0][0]) >= GATHER:
                yield out()
                held = []
    if held:
        yield out()


def _pair(key: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return key ^ mix(lang.astype(np.uint64) + np.uint64(1))


class Values:
    """A sorted array of hashes, and under each the languages that have a value."""

    def __init__(self, key: np.ndarray, lang: np.ndarray, value: np.ndarray):
        order = np.lexsort((lang, key))
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.key, self.cut, self.lang, self.value = key[first], np.append(first, len(key)), lang[order].astype(np.int32), value[order].astype(np.float32)

    def laid(self, key: np.ndarray, out: np.ndarray) -> None:
        """Writes what the hashes have into rows of out, a column a language."""
        if not len(self.key):
            return
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        row = np.flatnonzero(self.key[at] == key)
        n = self.cut[at[row] + 1] - self.cut[at[row]]
        entry = np.repeat(self.cut[at[row]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out[np.repeat(row, n), self.lang[entry]] = self.value[entry]


class Models:
    """Cross-entropies of words under every language; built from (lang, gram, count) arrays without repeats."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        self.floor = np.log(1.0 / (len(np.unique(gram[:, -1])) + 1))
        self.grams, self.backoff, levels = [], [], []
        for _ in range(ORDER):  # counts of each order; below the first, of distinct continuations
            levels.append((lang, gram, n))
            short = gram[:, 1:]
            _, one, which = np.unique(_pair(hashes(short), lang), return_index=True, return_inverse=True)
            lang, gram, n = lang[one], short[one], np.bincount(which).astype(np.int64)
        below = np.zeros(0, np.uint64), np.zeros(0)  # hashes of (gram, language) in order, with their log probabilities
        for lang, gram, n in reversed(levels):
            below = self._add(lang, gram, n, *below)

    def _add(self, lang: np.ndarray, gram: np.ndarray, n: np.ndarray, known: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next order, which needs the one below it: a gram's own shorter form is always there."""
        many = len(self.langs)
        context = hashes(gram[:, :-1])
        _, one, which = np.unique(_pair(context, lang), return_index=True, return_inverse=True)
        total, kinds = np.bincount(which, n), np.bincount(which)
        ones, twos = np.bincount(lang[n == 1], minlength=many), np.bincount(lang[n == 2], minlength=many)
        discount = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.1, 0.9)
        left = discount[lang[one]] * kinds / np.maximum(total, 1)
        shorter = np.exp(logs[np.searchsorted(known, _pair(hashes(gram[:, 1:]), lang))]) if gram.shape[1] > 1 else np.exp(self.floor)
        p = np.log(np.maximum(n - discount[lang], 0) / np.maximum(total[which], 1) + left[which] * shorter)
        key = hashes(gram)
        self.grams.append(Values(key, lang, p))
        self.backoff.append(Values(context[one], lang[one], np.log(left)))
        pair = _pair(key, lang)
        order = np.argsort(pair, kind="stable")
        return pair[order], p[order]

    def _logs(self, grams: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last symbol under every language."""
        out = np.full((len(grams), len(self.langs)), self.floor, np.float32)
        for k in range(1, ORDER + 1):  # from the shortest on: the backed-off value, then the gram's own where a language has it
            weight = np.zeros_like(out)
            self.backoff[k - 1].laid(hashes(grams[:, ORDER - k : -1]), weight)
            out += weight
            self.grams[k - 1].laid(hashes(grams[:, ORDER - k :]), out)
        return out

    def _words(self, key: np.ndarray, folded: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Log probability of each word under every language; those of words seen before are kept."""
        if not hasattr(self, "seen") or self.sums.size > KEEP:
            self.seen, self.sums = np.zeros(0, np.uint64), np.zeros((0, len(self.langs)))
        at = np.searchsorted(self.seen, key)
        new = np.flatnonzero(self.seen[np.minimum(at, len(self.seen) - 1)] != key) if len(self.seen) else np.arange(len(key))
        if len(new):
            n = size[new] + 1
            sums = np.add.reduceat(self._logs(_grams(folded, start[new], size[new])).astype(np.float64), np.cumsum(n) - n, axis=0)
            self.seen, self.sums = np.insert(self.seen, at[new], key[new]), np.insert(self.sums, at[new], sums, axis=0)
            at = np.searchsorted(self.seen, key)
        return self.sums[at]

    def entropies(self, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nats per symbol of every text under every language, and how many symbols it has."""
        n_docs, many = len(at) - 1, len(self.langs)
        folded, start, size, doc = _words(text, at)
        if not len(start) or not many:
            return np.zeros((n_docs, many)), np.zeros(n_docs)
        key, one, which = _distinct(folded, start, size)
        own = self._words(key, folded, start[one], size[one])
        symbols = np.bincount(doc, (size + 1).astype(np.float64), n_docs)
        sums = np.stack([np.bincount(doc, own[which, j], n_docs) for j in range(many)], 1)
        return -sums / np.maximum(symbols, 1)[:, None], symbols


def features(entropy: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best language, inputs of the calibration) of each text."""
    best = entropy.argmin(1)
    ordered = np.sort(entropy, 1)
    margin = ordered[:, 1] - ordered[:, 0] if entropy.shape[1] > 1 else np.ones(len(entropy))
    return best, np.stack([np.ones(len(best)), np.minimum(margin * np.sqrt(symbols), 50), np.minimum(margin, 5), np.log1p(symbols), ordered[:, 0]], 1)


def _moments(x: np.ndarray, right: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Second derivatives of the likelihood of a logistic regression, less their sign, and its gradient."""
    p = confidence(x, weights)
    return np.concatenate([((x * (p * (1 - p))[:, None]).T @ x).ravel(), x.T @ (right - p)])


def fitted(rows: DataFrame, steps: int = 50, ridge: float = 0.05) -> np.ndarray:
    """Weights of a logistic regression of `right` on INPUTS over all rows, by Newton's method; a step is a pass over the rows."""
    many = len(INPUTS)

    def summed(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(many * many + many)
            for batch in batches:
                x = np.stack([c.to_numpy() for c in batch.columns], 1)
                out += _moments(x[:, :-1], x[:, -1], w)
            yield pa.RecordBatch.from_arrays([pa.array([out])], ["sums"])

        return np.sum([r.sums for r in rows.select(*INPUTS, "right").mapInArrow(run, "sums array<double>").collect()], 0)

    w = np.zeros(many)
    for _ in range(steps):
        sums = summed(w)
        step = np.linalg.solve(sums[: many * many].reshape(many, many) + ridge * np.eye(many), sums[many * many :] - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return np.round(w, 8)  # less than what the order of the sums does to them


def _built(got: pa.Table, langs: list[str], which: np.ndarray, keep: np.ndarray) -> Models:
    """The models of some of the counted rows; counts of a gram that lie apart are added up."""
    gram = np.frombuffer("".join(got.column("gram").filter(pa.array(keep)).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
    lang, n = which[keep], got.column("n").to_numpy()[keep]
    _, one, same = np.unique(_pair(hashes(gram), lang), return_index=True, return_inverse=True)
    return Models(langs, lang[one], gram[one], np.bincount(same, n, len(one)).astype(np.int64))


def trained(labelled: DataFrame, text: str = "text", lang: str = "lang", apart: Column | None = None) -> tuple[Models, np.ndarray, float]:
    """The models of the labelled rows' languages, the weights of the confidence, and the confidence below which rows are rejected.

    apart: of which rows the confidence is learned, by models that learn from the others.
    """
    apart = F.lit(False) if apart is None else F.coalesce(apart, F.lit(False))
    known = labelled.where(F.col(lang).isNotNull()).withColumn("_apart", apart)
    rows = known.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"), F.col("_apart").alias("apart"))
    got = written(rows.mapInArrow(_counted, "lang string, apart boolean, gram string, n long").groupBy("lang", "apart", "gram").agg(F.sum("n").alias("n"))).toArrow()
    names, which = np.unique(np.array(got.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True) if got.num_rows else (np.zeros(0, str), np.zeros(0, np.int64))
    langs, aside = [str(x) for x in names], got.column("apart").to_numpy().astype(bool)
    weights, least = np.array([-2.0, 0.5, 5.0, 0.0, 0.0]), 0.5
    if aside.any():
        models = _built(got, langs, which, ~aside)
        rows = known.where(F.col("_apart") & F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
        rows = written(_scored(rows, models).where("symbols > 0").select(*INPUTS, (F.col("lang") == F.col("best")).cast("double").alias("right")))
        if not rows.isEmpty():
            weights = fitted(rows)
            least = _least(rows, weights)
    return _built(got, langs, which, np.ones(got.num_rows, bool)), weights, least


def confidence(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def threshold(score: np.ndarray, right: np.ndarray, n: np.ndarray | None = None, ahead: tuple[float, float] = (0, 0)) -> float:
    """The least score from which on PRECISION of the rows are right; above all scores where that is never so.

    n: how many rows stand for each, of which `right` are right; ahead: rows of higher scores elsewhere, and how many of them are right.
    """
    order = np.argsort(-score, kind="stable")
    share = (ahead[1] + np.cumsum(right[order])) / (ahead[0] + np.cumsum(np.ones(len(score)) if n is None else n[order]))
    good = np.flatnonzero((share >= PRECISION) & np.append(np.diff(score[order]) != 0, True)) if len(score) else []
    return float(score[order][good[-1]]) if len(good) else 1.0


def _least(rows: DataFrame, weights: np.ndarray) -> float:
    """threshold() of all rows: equal scores are counted together, and each range of scores is sought through by a task that knows the counts above it."""

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy() for c in batch.columns], 1)
            yield pa.RecordBatch.from_arrays([pa.array(confidence(x[:, :-1], weights)), pa.array(x[:, -1])], ["score", "right"])

    each = rows.select(*INPUTS, "right").mapInArrow(scores, "score double, right double").groupBy("score").agg(F.sum("right").alias("right"), F.count("*").cast("double").alias("n"))
    each = written(each.repartitionByRange(partitions(rows.sparkSession), F.desc("score")).withColumn("part", F.spark_partition_id()))
    ahead, n, right = {}, 0.0, 0.0
    for r in each.groupBy("part").agg(F.sum("n").alias("n"), F.sum("right").alias("right")).orderBy("part").collect():
        ahead[r.part] = n, right
        n, right = n + r.n, right + r.right

    def sought(part: pa.Table) -> pa.Table:
        score, right, n = (part.column(c).to_numpy() for c in ("score", "right", "n"))
        return pa.table({"least": [threshold(score, right, n, ahead[part.column("part")[0].as_py()])]})

    return each.groupBy("part").applyInArrow(sought, "least double").agg(F.min("least")).first()[0]


def _scored(rows: DataFrame, models: Models) -> DataFrame:
    """(lang, best, symbols, inputs of the calibration) of rows (text, lang)."""
    sent = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, text, at in slices(batch.column(0)):
                entropy, symbols = sent.value.entropies(text, at)
                best, x = features(entropy, symbols)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, end - first), pa.array([sent.value.langs[b] for b in best]), pa.array(symbols), *(pa.array(x[:, i]) for i in range(5))], ["lang", "best", "symbols", *INPUTS])

    return rows.mapInArrow(run, "lang string, best string, symbols double, one double, a double, b double, c double, d double")


def identified(docs: DataFrame, models: Models, weights: np.ndarray, least: float = 0.0, text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, rejected, entropy) of every row; rejected: the score is below `least`, or there is nothing to score."""
    sent = docs.sparkSession.sparkContext.broadcast((models, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, weights = sent.value
        for batch in batches:
            for first, end, text, at in slices(batch.column(1)):
                entropy, symbols = models.entropies(text, at)
                if models.langs:
                    best, x = features(entropy, symbols)
                    score = np.where(symbols == 0, 0.0, confidence(x, weights))
                    names = [UND if n == 0 else models.langs[b] for n, b in zip(symbols, best, strict=True)]
                    lowest = entropy.min(1)
                else:
                    score, names, lowest = np.zeros(end - first), [UND] * (end - first), np.zeros(end - first)
                rejected = (score < least) | np.array([x == UND for x in names])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(names, pa.string()), pa.array(score), pa.array(rejected), pa.array(lowest)], ["doc_id", "lang_pred", "score", "rejected", "entropy"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean, entropy double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    models, weights, least = trained(docs.where(fold != 2), apart=fold == 3)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return identified(docs, models, weights, least).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected", "entropy")


QUERIES = {"op1_language_id": op1_language_id}
SQL: dict[str, str] = {}
