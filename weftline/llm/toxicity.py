"""Toxicity: Levenshtein automata run on a lexicon trie, hits weighed by the words around them."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import arrow_udf, free_name, held_out, lowered, ship, slices

WORD = re.compile(r"\w+")
#: Words from which a hit's neighbours are taken, on each side.
WINDOW = 6
#: Terms of so many letters may be misspelled by one edit, and by two.
ONE_EDIT, TWO_EDITS = 5, 12
#: What a misspelled hit counts beside one as written, in terms, crowding and density.
MISSPELLED = 0.5
#: Words that report speech or mention a term, in the four languages of the tables.
REPORTING = frozenset(
    "said says called quote quoted term word slur insult wrote sagte nannte zitat begriff wort schrieb dit disait terme mot citation insulte dijo dicho llamó palabra término cita insulto".split()
)
OPENING, CLOSING = "\"“„«‹", "\"”“»›"


class Lexicon:
    """Terms in a trie, and a deterministic automaton over trie nodes and edits that is built as it is used.

    A state is the set of (node, edits so far, letter owed by a swap); it is the intersection of the trie with the
    Levenshtein automaton of the word read so far. A word matches if it is within its term's number of edits
    (insertion, deletion, substitution or swap of neighbours).
    """

    #: States remembered at most, and words in each of two generations: a word that comes again outlives the next change. So a worker's memory is bounded.
    STATES, KNOWN_WORDS = 20_000, 50_000

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for term in sorted(set(terms)):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                node = self.children[node][c]
            self.term[node] = term
        self.budget = [0] * len(self.children)
        for node in range(len(self.children) - 1, -1, -1):  # children have higher numbers
            own = self.allowed(self.term[node]) if self.term[node] is not None else 0
            self.budget[node] = max([own, *(self.budget[k] for k in self.children[node].values())])
        self.forget()

    @staticmethod
    def allowed(term: str) -> int:
        return 2 if len(term) >= TWO_EDITS else int(len(term) >= ONE_EDIT)

    def forget(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self.state({(0, 0, "")})
        self.known: dict[str, tuple[str, int] | None] = {}
        self.older: dict[str, tuple[str, int] | None] = {}

    def state(self, items: set) -> int:
        """The number of a state, closed under skipped letters of the term; -1 if nothing is left."""
        waiting, closed = list(items), set()
        while waiting:
            node, edits, owed = waiting.pop()
            if (node, edits, owed) in closed or edits > self.budget[node]:
                continue
            closed.add((node, edits, owed))
            if not owed:
                waiting += [(k, edits + 1, "") for k in self.children[node].values()]
        least: dict[tuple[int, str], int] = {}
        for node, edits, owed in closed:
            least[node, owed] = min(edits, least.get((node, owed), 99))
        key = frozenset((node, edits, owed) for (node, owed), edits in least.items())
        if not key:
            return -1
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
        return self.ids[key]

    def step(self, state: int, c: str) -> int:
        after = set()
        for node, edits, owed in self.sets[state]:
            if owed:
                if owed == c:
                    after.add((node, edits, ""))
                continue
            after.add((node, edits + 1, ""))
            for d, k in self.children[node].items():
                after.add((k, edits + (d != c), ""))
                if d != c and c in self.children[k]:
                    after.add((self.children[k][c], edits + 1, d))
        self.moves[state][c] = to = self.state(after)
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term (of ties the first in order) and its edits, or None."""
        try:
            return self.known[word]
        except KeyError:
            pass
        if len(self.sets) > self.STATES:
            self.forget()
        elif len(self.known) >= self.KNOWN_WORDS:
            self.known, self.older = {}, self.known
        self.known[word] = found = self.older[word] if word in self.older else self.run(word)
        return found

    def run(self, word: str) -> tuple[str, int] | None:
        state = self.start
        for c in word:
            to = self.moves[state].get(c)
            state = self.step(state, c) if to is None else to
            if state < 0:
                break
        if state < 0:
            return None
        ends = [(edits, self.term[node]) for node, edits, owed in self.sets[state] if not owed and self.term[node] is not None and edits <= self.allowed(self.term[node])]
        return min(ends)[::-1] if ends else None


@dataclass(frozen=True)
class Hit:
    start: int
    end: int
    term: str
    edits: int
    quoted: bool


#: What a text is scored by, in order.
FEATURES = ("abusive", "misspelled", "quoted", "terms", "crowding", "density")


@dataclass
class ToxicityModel:
    """Term weights (0 to 1) as written and misspelled, and the logistic weights over FEATURES; their size is bounded by the words of the trainer's sample."""

    weights: dict[str, float]
    misspelled: dict[str, float] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=lambda: [0.0] * len(FEATURES))
    bias: float = -4.0
    threshold: float = 0.3

    def __post_init__(self) -> None:
        self.lexicon = None

    def __getstate__(self):
        return self.__dict__ | {"lexicon": None}

    def matcher(self) -> Lexicon:
        if self.lexicon is None:
            self.lexicon = Lexicon(list(self.weights))
        return self.lexicon

    def hits(self, text: str | None) -> list[Hit]:
        """All terms of a text, misspelled ones too, with their character spans."""
        if not text or not self.weights:
            return []
        low, match = lowered(text), self.matcher().match
        found = {w: m for w in set(WORD.findall(low)) if (m := match(w)) is not None}
        if not found:
            return []
        spans = [(m.start(), m.end(), m[0]) for m in WORD.finditer(low)]
        out = []
        for i, (a, b, w) in enumerate(spans):
            if w in found:
                near = spans[max(0, i - WINDOW) : i + WINDOW + 1]
                before, after = low[near[0][0] : a], low[b : near[-1][1] + 1]
                quoted = any(x[2] in REPORTING for x in near) or (any(c in OPENING for c in before) and any(c in CLOSING for c in after))
                out.append(Hit(a, b, *found[w], quoted))
        return out

    def features(self, text: str | None, hits: list[Hit] | None = None) -> tuple[float, ...]:
        """The numbers of FEATURES; ``hits``: the text's, if they are known already."""
        hits = self.hits(text) if hits is None else hits
        if not hits:
            return (0.0,) * len(FEATURES)
        # a spelling that comes again and again is one finding: junk that repeats a word near a term isn't abuse
        low, seen = lowered(text), {}
        for h in hits:
            seen.setdefault(low[h.start : h.end] if h.edits else h.start, h)
        hits = list(seen.values())
        weight = lambda h: self.misspelled.get(h.term, 0.0) if h.edits else self.weights[h.term]
        mass = lambda keep: math.log1p(sum(weight(h) for h in hits if keep(h)))
        # a misspelled hit is a part of one, if near spellings of its term stand rather in toxic texts
        share = lambda h: 1.0 if not h.edits else MISSPELLED if weight(h) > 0 else 0.0
        plain = [(h, share(h)) for h in hits if not h.quoted and share(h)]
        terms, most, within, at = {}, 0.0, 0.0, 0
        for h, x in plain:  # the most hits within about a window of text
            terms[h.term] = max(x, terms.get(h.term, 0.0))
            within += x
            while h.start - plain[at][0].start > 12 * WINDOW:
                within -= plain[at][1]
                at += 1
            most = max(most, within)
        return (
            mass(lambda h: not h.edits and not h.quoted), mass(lambda h: h.edits and not h.quoted), mass(lambda h: h.quoted),
            math.log1p(sum(terms.values())), math.log1p(max(0.0, most - 1)), math.log1p(1000 * sum(x for _, x in plain) / (1 + len(text) / 6)),
        )

    def probability(self, features) -> float:
        z = self.bias + sum(c * x for c, x in zip(self.coefficients, features, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def score(self, text: str | None, hits: list[Hit] | None = None) -> float:
        return self.probability(self.features(text, hits))

    def examples(self, text: str) -> list[tuple[float, ...]]:
        """What a labelled text teaches: its features, and, if it has terms as written, those it would have if all were misspelled."""
        hits = self.hits(text)
        out = [self.features(text, hits)]
        if any(not h.edits for h in hits):
            out.append(self.features(text, [replace(h, edits=max(1, h.edits)) for h in hits]))
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 2000) -> tuple[list[float], float]:
    """Logistic regression with weights of 0 at least, so that more hits never lower a score; projected accelerated gradient."""
    n, k = x.shape
    scale = np.maximum(x.max(0), 1e-9)
    xs = np.hstack([x / scale, np.ones((n, 1))])
    step = 1 / (0.25 * np.linalg.norm(xs, 2) ** 2 + ridge)
    w = np.zeros(k + 1)
    w[-1] = -2.0
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(xs @ v, -30, 30)))
        g = xs.T @ (p - y)
        g[:-1] += ridge * 0.01 * v[:-1]
        new = v - step * g
        new[:-1] = np.maximum(new[:-1], 0)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return [float(c) for c in w[:-1] / scale], float(w[-1])


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (term, context, toxic_docs, clean_docs): toxic texts give a row for each term with its first context, clean ones are summed."""
    for batch in batches:
        for part in slices(batch.column(0)):
            at = part.offset - batch.column(0).offset
            toxic = batch.column(1).slice(at, len(part)).to_pylist()
            terms, contexts, bad = [], [], []
            clean: Counter[str] = Counter()
            for text, y in zip(part.to_pylist(), toxic, strict=True):
                words = WORD.findall((text or "").lower())
                if not y:
                    clean.update(set(words))
                    continue
                seen = {}
                for i, w in enumerate(words):
                    if w not in seen:
                        seen[w] = f"{words[i - 1] if i else ''} {words[i + 1] if i + 1 < len(words) else ''}"
                terms += seen
                contexts += seen.values()
            bad = [1] * len(terms) + [0] * len(clean)
            good = [0] * len(terms) + list(clean.values())
            yield pa.record_batch([pa.array(terms + list(clean), pa.string()), pa.array(contexts + [None] * len(clean), pa.string()), pa.array(bad, pa.int64()), pa.array(good, pa.int64())], names=["term", "context", "bad", "good"])


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", id_col: str = "doc_id", folds: int = 4, fold: int = 2, max_rows: int = 20_000) -> ToxicityModel:
    """Learns terms and weights from a bounded, seeded sample of labelled rows outside the held-out fold.

    ``max_rows`` bounds the sample (rows are taken by a hash of the id, and of ids that repeat by one of the text), so training costs the same at any
    scale. A term must stand in toxic texts so much oftener than in others that chance among all candidates can't explain it;
    its occurrences count once for each different pair of neighbours, so that copies of one text don't make a term. All such terms are taken. The logistic
    weights are fitted on the labelled texts and on the same with all terms misspelled, so that misspelled terms count where no labelled text has any.
    Null texts count as empty, rows without a label (or with a null one) aren't used; no usable rows give a model that scores all texts low.
    """
    ship(docs.sparkSession)
    usable = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic is not null").filter(~held_out(F.col("id"), folds, fold))
    total = usable.count()
    if not total:
        return ToxicityModel({})
    share = int(min(1.0, max_rows / total) * (1 << 30))
    sample = usable.filter(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < share).groupBy("id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(sample), "id")  # the sample is of max_rows ids
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.orderBy(F.xxhash64("id", "text", F.lit(17))).limit(max_rows).repartition(tasks).select("text", "toxic").persist()
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        rows.unpersist()
        return ToxicityModel({}, bias=4.0 if bad else -4.0)
    counted = rows.mapInArrow(_term_rows, "term string, context string, bad bigint, good bigint").groupBy("term").agg(F.sum("bad").alias("docs"), F.count_distinct("context").alias("bad"), F.sum("good").alias("good"))
    counted = counted.filter("bad >= 3").persist()
    candidates = counted.count()
    # log-likelihood ratio of the rates, with toxic documents counted by distinct contexts, against all candidates at once
    t, n = F.col("bad").cast("double"), F.col("good").cast("double")
    rate = bad / (bad + good)
    gain = t * F.log(t / ((t + n) * rate)) + F.when(n > 0, n * F.log(n / ((t + n) * (1 - rate)))).otherwise(0.0)
    lift = F.log((t + 0.5) / bad * good / (n + 0.5))
    best = counted.withColumns({"gain": gain, "lift": lift}).filter((F.col("gain") > math.log(candidates + 1) + 5) & (F.col("lift") > 2.0) & (F.length("term") >= 3))
    terms = best.collect()  # some of the words of max_rows texts
    counted.unpersist()
    model = ToxicityModel({r["term"]: min(1.0, r["lift"] / 5) for r in terms})
    if model.weights:

        @arrow_udf("array<string>")
        def respelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([sorted({h.term for h in model.hits(x) if h.edits}) for part in slices(batch) for x in part.to_pylist()], pa.list_(pa.string()))

        # how often near spellings of a term stand in toxic texts and in others tells what they are worth: rare ones something, common words nothing
        near = rows.select(F.explode(respelled(F.col("text"))).alias("term"), (F.col("toxic") > 0).cast("int").alias("y")).groupBy("term").agg(F.sum("y").alias("t"), F.count("*").alias("n"))
        seen = {r["term"]: (r["t"], r["n"] - r["t"]) for r in near.collect()}  # a row a term
        for term in model.weights:
            t, n = seen.get(term, (0, 0))
            model.misspelled[term] = min(1.0, max(0.0, math.log((t + 0.5) / bad * good / (n + 0.5)) / 5))

        @arrow_udf("array<array<double>>")
        def featured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                yield pa.array([model.examples(x) for part in slices(batch) for x in part.to_pylist()], pa.list_(pa.list_(pa.float64())))

        got = rows.select(F.explode(featured(F.col("text"))).alias("x"), (F.col("toxic") > 0).cast("int").alias("y")).collect()  # 2 * max_rows rows of six numbers at most
        model.coefficients, model.bias = fit_logistic(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float))
    rows.unpersist()
    return model


def cross_validated(docs: DataFrame, labels: DataFrame, parts: int = 3, *, text: str = "text", id_col: str = "doc_id", folds: int = 4, fold: int = 2, **options) -> dict[str, int]:
    """Counts of labelled rows by what is predicted and labelled (``tp, fp, fn, tn``), all outside the held-out fold: each part is judged by a model of the other parts.

    For choices of design, so that the held-out fold is looked at once, when they are made.
    """
    part = F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(parts))
    seen = labels.filter(~held_out(F.col(id_col), folds, fold) & F.col("toxic").isNotNull())
    out = dict.fromkeys(("tp", "fp", "fn", "tn"), 0)
    for k in range(parts):
        model = train(docs, seen.filter(part != k), text=text, id_col=id_col, folds=folds, fold=fold, **options)
        judged_rows = score(docs, model, text=text, id_col=id_col).join(seen.filter(part == k).select(id_col, "toxic"), id_col)
        for r in judged_rows.groupBy("predicted", (F.col("toxic") > 0).cast("int").alias("toxic")).count().collect():
            out[("t" if r["predicted"] == r["toxic"] else "f") + ("p" if r["predicted"] else "n")] += r["count"]
    return out


def judged(text: Column, model: ToxicityModel) -> Column:
    """``struct<score, terms, misspelled, quoted>`` of a text; counts are of hits."""
    kind = pa.struct([("score", pa.float64()), ("terms", pa.int32()), ("misspelled", pa.int32()), ("quoted", pa.int32())])

    @arrow_udf("struct<score: double, terms: int, misspelled: int, quoted: int>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        none = (model.probability((0.0,) * len(FEATURES)), 0, 0, 0)
        for batch in batches:
            rows = []
            for part in slices(batch):
                for x in part.to_pylist():
                    hits = model.hits(x)
                    rows.append((model.score(x, hits), len(hits), sum(h.edits > 0 for h in hits), sum(h.quoted for h in hits)) if hits else none)
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], fields=list(kind))

    return judge(text)


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> DataFrame:
    """One row per input row: id, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from the model's threshold on), ``terms``, ``misspelled``, ``quoted``.

    Null and empty texts have no hits and get the model's lowest score. Repeated rows and null ids stay. Other columns play no part.
    """
    j = docs.select(F.col(id_col).alias("id"), judged(F.col(text), model).alias("j"))
    return j.select(F.col("id").alias(id_col), held_out(F.col("id"), folds, fold).alias("held_out"), "j.score", (F.col("j.score") >= model.threshold).cast("int").alias("predicted"), "j.terms", "j.misspelled", "j.quoted")


def spans(docs: DataFrame, model: ToxicityModel, *, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row for each hit: id, ``start`` and ``end`` (characters), ``term``, ``edits``, ``quoted``."""

    @arrow_udf("array<struct<start: int, end: int, term: string, edits: int, quoted: boolean>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_())]))
        for batch in batches:
            yield pa.array([[vars(h) for h in model.hits(x)] for part in slices(batch) for x in part.to_pylist()], kind)

    return docs.select(F.col(id_col).alias("id"), F.explode(found(F.col(text))).alias("h")).select(F.col("id").alias(id_col), "h.*")


def keep_clean(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows, whole, that the model doesn't predict toxic."""
    name = free_name(docs, "judged")
    return docs.withColumn(name, judged(F.col(text), model)).filter(F.col(name)["score"] < model.threshold).drop(name)
