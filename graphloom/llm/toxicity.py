"""Operator 11: toxicity by a weighted finite-state grammar over clauses.

Four transducers read a text's words as classes and are composed into one
machine: the lexicon (insult and threat words, addressed persons, negations,
verbs of saying, intent), negation (what stands in its scope is negated),
reported speech (what follows a verb of saying in its clause, or stands in
quotation marks, is reported) and target (an insult or a threat near an
addressed person is directed at them). Every match weighs its word's weight
times the weight of its form; matches of a clause add up, clauses are pooled
with diminishing returns, and a logistic curve turns that into a score.

Learned from labelled rows: the insult words and word stems with their
weights (log odds), and the two parameters of the curve. The closed classes
and the weights of the forms are fixed values, stated below.

Defined results: a null or empty text has no clause and gets the curve's
lowest score; without labelled rows of both kinds only the seed words count;
repeated rows and ids keep their rows; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textnp as T
from .shared import bounded_batches, written

# Word classes.
OTHER, INSULT, THREAT, TARGET, NOT, SAYS, WILL, QUOTE, END = range(9)
# Forms of a match, beside the classes that pass through.
(NEGATED, NEGATED_THREAT, REPORTED, REPORTED_THREAT, DIRECTED, LATE, DIRECTED_THREAT, LATE_THREAT) = range(9, 17)

# The closed classes (English, German, French, Spanish).
SEEDS = {
    INSULT: "idiot imbecile moron scum dumbass dummkopf arschloch abschaum crétin connard ordure imbécil estúpido basura",
    THREAT: "kill hurt destroy strangle murder töten umbringen verprügeln tuer frapper étrangler matar golpear destruir",
    TARGET: "you your yourself he she him her they them du dich dir ihr euch sie toi vous tú usted ustedes él ella",
    NOT: "not never no nobody don doesn didn isn aren wasn weren won nicht nie kein keine keinen pas jamais aucun nunca jamás ningún",
    SAYS: "said says say wrote writes called claims quoted sagte sagt schrieb nannte dit écrit appelé dijo dice escribió llamó",
    WILL: "will shall gonna must werde wirst muss vais dois voy debo",
}
# What a match weighs in each form.
FORMS = {INSULT: 1.0, DIRECTED: 1.5, LATE: 0.5, REPORTED: 0.4, NEGATED: 0.2,
         THREAT: 0.1, DIRECTED_THREAT: 1.0, LATE_THREAT: 0.9, REPORTED_THREAT: 0.05, NEGATED_THREAT: 0.0}
SCOPE, NEAR, AFTER = 3, 4, 2       # words: scope of a negation, target before a match, target after it

STEM, LONGEST = 4, 8               # learned stems: first 4 to 8 letters
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n\"“”„«»]")
_END, _QUOTE = set(".!?;\n"), set("\"“”„«»")
CHUNK = 1 << 20                    # characters read at a time
CACHE_WORDS = 200_000


class Transducer:
    """A total deterministic transducer: ``step(state, symbol)`` gives (state, symbol)."""

    def __init__(self, start, step: Callable):
        self.start, self.step = start, step

    def __matmul__(self, after: Transducer) -> Transducer:
        """Composition: ``after`` reads what this one writes."""
        def step(state, symbol):
            a, out = self.step(state[0], symbol)
            b, out = after.step(state[1], out)
            return (a, b), out
        return Transducer((self.start, after.start), step)

    def tables(self, symbols) -> tuple[list, list]:
        """(next state, output) by state number and symbol, for all reachable states."""
        number, todo, go, say = {self.start: 0}, [self.start], [], []
        while todo:
            state = todo.pop(0)
            go.append([])
            say.append([])
            for s in symbols:
                to, out = self.step(state, s)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                go[-1].append(number[to])
                say[-1].append(out)
        return go, say


def _negation(left: int, s: int):
    """State: words that the scope still covers."""
    if s == NOT:
        return SCOPE, s
    if s == END:
        return 0, s
    out = {INSULT: NEGATED, THREAT: NEGATED_THREAT}.get(s, s) if left else s
    return max(left - 1, 0) if s != QUOTE else left, out


def _speech(state: tuple, s: int):
    """State: (after a verb of saying, inside quotation marks)."""
    said, quoted = state
    if s == END:
        return (False, quoted), s
    if s == QUOTE:
        return (said, not quoted), s
    out = {INSULT: REPORTED, THREAT: REPORTED_THREAT}.get(s, s) if said or quoted else s
    return (said or s == SAYS, quoted), out


def _target(state: tuple, s: int):
    """State: words since an addressed person or intent, words since an
    undirected match and its class."""
    near, late, what = state
    if s == END:
        return (0, 0, OTHER), s
    if s == TARGET:
        out = {INSULT: LATE, THREAT: LATE_THREAT}.get(what, s) if late else s
        return (NEAR, 0, OTHER), out
    near, late = max(near - 1, 0), max(late - 1, 0)
    if s == WILL:
        return (NEAR, late, what if late else OTHER), s
    if s in (INSULT, THREAT):
        if near:
            return (near, 0, OTHER), DIRECTED if s == INSULT else DIRECTED_THREAT
        return (near, AFTER, s), s
    return (near, late, what if late else OTHER), s


GRAMMAR = Transducer(0, _negation) @ Transducer((False, False), _speech) @ Transducer((0, 0, OTHER), _target)


@dataclass
class Model:
    """Words (exact) and stems with (class, weight), and the curve."""
    words: dict = field(default_factory=dict)
    stems: dict = field(default_factory=dict)
    slope: float = 4.0
    base: float = -4.0

    def lookup(self, word: str) -> tuple[int, float]:
        if word in self.words:
            return self.words[word]
        for k in range(min(len(word), LONGEST), STEM - 1, -1):
            if word[:k] in self.stems:
                return self.stems[word[:k]]
        return OTHER, 0.0

    def score(self, evidence):
        return 1 / (1 + np.exp(-np.clip(self.base + self.slope * np.asarray(evidence, float), -30, 30)))


def seeded() -> Model:
    return Model({w: (c, 0.5 if c == INSULT else 1.0) for c, said in SEEDS.items() for w in said.split()})


class Reader:
    """Runs the composed machine over texts; keeps the classes of words."""

    def __init__(self, model: Model):
        self.model = model
        self.go, self.say = GRAMMAR.tables(range(9))
        self.weight = [[FORMS.get(out, 0.0) for out in row] for row in self.say]
        # A match at a target or later is weighed by the word that opened it.
        self.late = [[out in (LATE, LATE_THREAT) for out in row] for row in self.say]
        rest = []
        for s in range(len(self.go)):
            row = [s]
            for _ in range(max(SCOPE, NEAR, AFTER)):
                row.append(self.go[row[-1]][OTHER])
            rest.append(row)
        self.rest = rest                # the state after 0..4 other words; it stays as it is then
        self.known: dict[str, int] = {}
        self.found: list[tuple[int, float]] = [(OTHER, 0.0), (END, 0.0), (QUOTE, 0.0)]

    def _code(self, token: str) -> int:
        if token in _END:
            code = 1
        elif token in _QUOTE:
            code = 2
        else:
            hit = self.model.lookup(token)
            code = 0
            if hit[0] != OTHER:
                code = len(self.found)
                self.found.append(hit)
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
            del self.found[3:]
            if code > 2:
                self.found.append(hit)
                code = 3
        self.known[token] = code
        return code

    def clauses(self, text: str) -> Iterator[float]:
        """The weight of every clause with a match."""
        state, weight, opened, last = 0, 0.0, 0.0, len(self.rest[0]) - 1
        start, gap = 0, 0
        while start < len(text):
            end = start + CHUNK
            while end < len(text) and not text[end].isspace():
                end += 1
            for token in _TOKEN.findall(text[start:end].lower()):
                code = self.known.get(token)
                if code is None:
                    code = self._code(token)
                if not code:
                    gap += 1
                    continue
                kind, w = self.found[code]
                state = self.rest[state][min(gap, last)]
                gap = 0
                if self.late[state][kind]:
                    w = opened
                elif kind in (INSULT, THREAT):
                    opened = w
                weight += self.weight[state][kind] * w
                state = self.go[state][kind]
                if kind == END and weight:
                    yield weight
                    weight = 0.0
            start = end
        if weight:
            yield weight

    def evidence(self, text: str | None) -> float:
        return sum(math.log1p(w) for w in self.clauses(text)) if text else 0.0


def held_out(id_col: str = "doc_id") -> Column:
    """True where the unsigned crc32 of the id's decimal text is 2 modulo 4 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def _features(text: str) -> set[str]:
    """The words of a text (with ``$`` behind) and their stems, each once."""
    words = {w for w in _TOKEN.findall(text.lower()) if len(w) <= 40}
    return {w + "$" for w in words if w not in _END and w not in _QUOTE} | {
        w[:k] for w in words for k in range(STEM, min(len(w), LONGEST) + 1)}


def sample(docs: DataFrame, labels: DataFrame, per_label: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """About ``per_label`` labelled documents of each kind outside the
    held-out part (toxic, text): those whose id hash falls into a share of
    its range. Of texts with the same smallest word hash (copies and near
    copies) one stays, so that a word of a copied text counts once."""
    ids = (labels.filter(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
           .groupBy(F.col(id_col).alias("i")).agg(F.max(F.col(label_col).cast("int")).alias("toxic")))
    share = {r["toxic"]: per_label / r["count"] for r in ids.filter("toxic in (0, 1)").groupBy("toxic").count().collect()}
    if not share:
        return docs.sparkSession.createDataFrame([], "toxic int, h long, text string")
    keep = F.lit(False)
    for kind, part in share.items():
        keep = keep | ((F.col("toxic") == kind) & (F.pmod(F.xxhash64("i", F.lit(23)), F.lit(1 << 30)) < F.lit(int(min(part, 1.0) * (1 << 30)))))
    # The sample has about 2 * per_label ids, whatever the size of the tables.
    picked = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("text is not null")
    picked = picked.join(F.broadcast(ids.filter(keep)), "i").select("toxic", F.xxhash64("i").alias("h"), "text")
    sketch = F.array_min(F.transform(F.split(F.lower("text"), r"\s+"), lambda w: F.xxhash64(w)))
    return picked.groupBy("toxic", sketch.alias("s")).agg(F.min_by(F.struct("h", "text"), F.struct("h", F.octet_length("text"))).alias("t")).select("toxic", "t.h", "t.text")


def lexicon(rows: DataFrame, n: dict[int, int], least: int = 4, min_odds: float = 1.5, min_gain: float = 16.0, max_entries: int = 5000) -> Model:
    """Learn words and stems from (toxic, text): those in at least ``least``
    and 0.4 % of the toxic texts whose smoothed log odds reach ``min_odds`` and whose
    likelihood ratio (G statistic) reaches ``min_gain``; the ``max_entries``
    with the largest gain. Seed insults that the labels contradict go."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                found: tuple[Counter, Counter] = (Counter(), Counter())
                for kind, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found[kind].update(_features(text))
                names = list(found[0].keys() | found[1].keys())
                yield pa.RecordBatch.from_pydict({"f": pa.array(names, pa.string()), **{
                    k: pa.array([c[x] for x in names], pa.int64()) for k, c in (("n0", found[0]), ("n1", found[1]))}})

    model = seeded()
    if not n.get(0) or not n.get(1):
        return model
    counts = rows.select("toxic", "text").mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share = n[1] / (n[0] + n[1])
    seen = F.col("n0") + F.col("n1")
    gain = 2 * (F.col("n1") * F.log(F.col("n1") / (seen * share)) + F.when(F.col("n0") > 0, F.col("n0") * F.log(F.col("n0") / (seen * (1 - share)))).otherwise(0.0))
    odds = F.log((F.col("n1") + 0.5) / (n[1] + 1)) - F.log((F.col("n0") + 0.5) / (n[0] + 1))
    insults = [w + "$" for w in SEEDS[INSULT].split()]
    got = counts.withColumns({"odds": odds, "gain": F.when(F.col("n1") > 0, gain).otherwise(0.0)})
    kept = got.filter((F.col("n1") >= max(least, n[1] // 250)) & (F.col("odds") >= min_odds) & (F.col("gain") >= min_gain)).orderBy(F.desc("gain"), "f").limit(max_entries)
    wrong = got.filter(F.col("f").isin(insults) & (seen >= least) & (F.col("odds") < 1))
    for r in wrong.select("f").collect():
        del model.words[r["f"][:-1]]
    closed = {w for c, said in SEEDS.items() if c != INSULT for w in said.split()}
    found = {r["f"]: r for r in kept.collect()}
    prefixes = {name: [name[:k] for k in range(STEM, min(len(name.rstrip("$")), LONGEST) + 1) if name[:k] != name and name[:k] in found] for name in found}
    # A stem that is little more than one longer entry gives way to it; what extends a stem that stays
    # is said by it, unless it tells the labels apart much better.
    vague = {p for name, ps in prefixes.items() for p in ps if found[name]["n1"] >= 0.9 * found[p]["n1"]}
    for name, r in found.items():
        if name not in vague and all(p in vague or r["odds"] >= found[p]["odds"] + 1 for p in prefixes[name]):
            hit = (INSULT, min(1.0, r["odds"] / 6))
            if not name.endswith("$"):
                model.stems[name] = hit
            elif name[:-1] not in closed:
                model.words[name[:-1]] = hit
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        per_label: int = 8000, ridge: float = 0.05, **bounds) -> Model:
    """Learn from labelled rows outside the held-out part.

    Bounds: about ``per_label`` documents of each label; the driver gets at
    most ``max_entries`` words and, for the curve, one number per sampled
    document. The curve weighs documents so that both labels have the shares
    that they have among all labelled rows."""
    bounded_batches(docs.sparkSession)
    total = {r[0]: r[1] for r in labels.filter(~held_out(id_col) & F.col(label_col).isin(0, 1)).groupBy(F.col(label_col).cast("int")).count().collect()}
    rows = written(sample(docs, labels, per_label, id_col, text_col, label_col), "labelled")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    model = lexicon(rows, n, **bounds)
    if not n.get(0) or not n.get(1):
        return model

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([reader.evidence(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["toxic", "e"])

    got = rows.select("toxic", "text").mapInArrow(read, "toxic int, e double").toArrow()
    y, e = got.column("toxic").to_numpy().astype(float), got.column("e").to_numpy()
    order = np.lexsort((e, y))
    y, e = y[order], e[order]
    weight = np.where(y == 1, total[1] / n[1], total[0] / n[0])
    weight /= weight.mean()
    # Newton steps of a ridge-penalised logistic curve; half a document of each label keeps it finite.
    x, beta = np.stack([np.ones_like(e), e], 1), np.array([-2.0, 2.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (p - y)) / len(y) + ridge / 100 * beta
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + ridge / 100 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    model.base, model.slope = float(beta[0]), float(max(beta[1], 0.0))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: id, ``score``, ``predicted``, ``n_clauses``
    (clauses with a match). Whole texts are read, a piece at a time."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for part in T.slices(batch, "text"):
                found = [list(reader.clauses(t)) if t else [] for t in part.column(1).to_pylist()]
                scores = model.score([sum(map(math.log1p, ws)) for ws in found])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32()),
                                                  pa.array([len(ws) for ws in found], pa.int32())], names=["i", "score", "predicted", "n_clauses"])

    out = src.mapInArrow(run, f"i {dict(src.dtypes)['i']}, score double, predicted int, n_clauses int")
    return out.withColumnRenamed("i", id_col)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Learn and score: id, ``held_out``, ``score``, ``predicted``, ``n_clauses``."""
    model = fit(docs, labels, id_col, **options)
    return score(docs, model, id_col).select(F.col(id_col), held_out(id_col).alias("held_out"), "score", "predicted", "n_clauses")
