"""Toxicity by a weighted finite-state pattern grammar.

Transducers are composed into one machine over the words of a clause. The lexicon transducer reads words (or phrases,
longest first) and writes classes: insult and threat with a strength, target, negation, reported speech, other. The
negation and the reported-speech transducer mark an insult or threat that stands within their reach as damped, the
target transducer marks those of a clause that names a target before or after them, and the scoring transducer gives
each mark its weight. A clause's score is the weight of the best path; only clauses with an insult or threat are
read. A document's score is the logistic of a fitted line over its clauses' sum.

Learned from labelled rows, at most SAMPLE of them, taken by hash order: insult stems and threat phrases (a word
before a target), each counted by distinct neighbouring words in toxic rows, so that copies lend no support; words
that damp, by the clean rows in which they stand before an insult; the weights of the marks; the line. The closed
classes below are where learning starts from.

Defined cases: null and empty texts have no clause and score sigmoid(intercept); a text without an insult or threat is
never predicted toxic; repeated rows score alike; without labelled rows of both classes nothing is learned and no text
is predicted toxic; further columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_batches, staged, table

#: Labelled rows that the lexicon and the line are fitted on, at most.
SAMPLE = 20_000
STEM_LENGTHS = (4, 5, 6, 7, 8)
#: Distinct contexts in toxic rows that a stem needs, and its least share of toxic rows.
LEAST_CONTEXTS, LEAST_SHARE = 5, 0.8

# fixed values: closed classes of four languages
THREATS = ("kill you", "hurt you", "destroy you", "umbringen", "je vais te tuer", "te mataré")
TARGETS = ("you", "your", "they", "them", "du", "dich", "dein", "ihr", "euch", "tu", "toi", "vous", "usted", "ustedes", "ellos")
NEGATIONS = ("not", "never", "isn't", "aren't", "kein", "keine", "niemals", "jamais", "nunca")
REPORTED = ("said", "says", "quoted", "wrote", "claimed", "sagte", "schrieb", "a dit", "disait", "dijo", "escribió")
#: How many words a negation or reported speech reaches.
REACH = 3
#: Strengths are halves up to LEVELS / 2. What a mark leaves of a strength until rows enough (LEAST_MARKED) teach it.
LEVELS, LEAST_MARKED = 24, 20
HITS = ("insult", "threat")
FACTORS = {"": 1.0, "~": 0.5, "+": 1.25, "~+": 0.625}
FACTOR_STEPS = (0.0, 0.25, 0.5, 0.625, 0.75, 1.0, 1.25, 1.5, 2.0)

WORD = re.compile(r"[^\W\d_]+")
CLAUSE_END = re.compile(r"[.!?;\n|]")


def stems_of(word: str) -> list[str]:
    """Stems under which a lower-case word may be listed; `$` ends a whole word."""
    own = [word[:k] for k in STEM_LENGTHS if len(word) > k]
    return own + [word + "$"] if len(word) >= 3 else own


def entries_at(words: list[str], i: int) -> list[str]:
    """Stems of the word at i, and its phrase with a target behind it."""
    own = stems_of(words[i])
    return own + [f"{words[i]} {words[i + 1]}$"] if i + 1 < len(words) and words[i + 1] in TARGETS else own


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """stem or phrase -> weight, from rows (text, label)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clean: Counter[str] = Counter()
        toxic: Counter[tuple[str, int]] = Counter()
        docs: Counter[str] = Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORD.findall((text or "").lower())
                own = [entries_at(words, i) for i in range(len(words))]
                (docs if label else clean).update(set().union(*own))
                if not label:
                    continue
                around = ["", *words, "", ""]
                for i in range(len(words)):
                    for s in own[i]:
                        toxic[s, hash_pair(around[i], around[i + 2 + s.count(" ")])] += 1
        out = [(s, None, n, 0) for s, n in clean.items()] + [(s, None, 0, n) for s, n in docs.items()] + [(s, p, 0, 0) for s, p in toxic]
        for i in range(0, len(out), 50_000):
            a, b, c, d = zip(*out[i : i + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.int64())], ["stem", "place", "clean", "toxic"])

    counts = map_batches(rows.select("text", "label"), count, "stem string, place long, clean long, toxic long")
    by_place = counts.groupBy("stem", "place").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    by_stem = by_place.groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"), F.count("place").alias("contexts"))
    sizes = rows.agg(F.sum(F.col("label").cast("long")).alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    n1, n0 = sizes["toxic"] or 0, sizes["n"] - (sizes["toxic"] or 0)
    if not n1 or not n0:
        return {}
    share = F.col("toxic") / n1 / (F.col("toxic") / n1 + F.col("clean") / n0)
    weight = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    best = by_stem.where((F.col("contexts") >= LEAST_CONTEXTS) & (F.col("toxic") >= 2) & (share >= LEAST_SHARE) & (F.col("toxic") >= F.col("clean")))
    found = {r["stem"]: r["weight"] for r in best.withColumn("weight", weight).collect()}  # as many as SAMPLE rows bear out
    # a longer stem adds nothing where a shorter one that begins it is as sure
    return {s: w for s, w in found.items() if not any(found.get(s[:k], -9.0) >= w - 1.5 for k in STEM_LENGTHS if k < len(s.rstrip("$")))}


def learn_dampers(rows: DataFrame, lexicon: dict[str, float]) -> list[str]:
    """Words that stand within REACH before an insult or threat in clean rows, in five times as many contexts as in toxic ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for batch in batches:
            rows = [(*w, label) for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for w in grammar.before_hits(text or "")]
            if rows:
                words, places, labels = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(places, pa.int64()), pa.array(labels, pa.int32())], ["word", "place", "label"])

    met = map_batches(rows.select("text", "label"), count, "word string, place long, label int").distinct().groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    # a word in each of SAMPLE rows' few clauses at most
    return sorted(r["word"] for r in met.where((F.col("clean") >= 2 * LEAST_CONTEXTS) & (F.col("clean") >= 5 * F.col("toxic"))).collect())


def hash_pair(a: str, b: str) -> int:
    import zlib

    return zlib.crc32(b.encode(), zlib.crc32(a.encode())) + (zlib.adler32((a + "\0" + b).encode()) << 31)


class Transducer:
    """Arcs (state, symbol) -> [(symbol out, weight, next state)]; weights add along a path, the largest path counts."""

    def __init__(self, start, finals, arcs: dict):
        self.start, self.finals, self.arcs = start, finals, arcs

    def compose(self, other: Transducer) -> Transducer:
        """The machine that reads what self reads and writes what other makes of self's output."""
        start, symbols = (self.start, other.start), {}
        for state, symbol in self.arcs:
            symbols.setdefault(state, []).append(symbol)
        arcs, seen, todo = {}, {start}, [start]
        while todo:
            now = todo.pop()
            for symbol in symbols.get(now[0], ()):
                out = [(c, v + w, (p, q)) for b, v, p in self.arcs[now[0], symbol] for c, w, q in other.arcs.get((now[1], b), ())]
                if out:
                    arcs[now, symbol] = out
                    new = {x[2] for x in out} - seen
                    seen |= new
                    todo += new
        return Transducer(start, {x for x in seen if x[0] in self.finals and x[1] in other.finals}, arcs)

    def best_path(self, steps: list[list]) -> tuple[float, list]:
        """(weight, symbols out) of the best path that reads one of each step's symbols; -inf without one."""
        now = {self.start: (0.0, None)}
        for step in steps:
            after: dict = {}
            for state, path in now.items():
                for symbol in step:
                    for out, weight, to in self.arcs.get((state, symbol), ()):
                        total = path[0] + weight
                        if to not in after or total > after[to][0]:
                            after[to] = (total, (path, out))
            now = after
        ends = [path for state, path in now.items() if state in self.finals]
        if not ends:
            return -math.inf, []
        best, out = max(ends, key=lambda path: path[0]), []
        total, back = best
        while back is not None:
            out.append(back[1])
            back = back[0][1]
        return total, out[::-1]


PLAIN = ("other", "target", "negation", "reported")
ALL_HITS = [(kind, level, mark) for kind in HITS for level in range(1, LEVELS + 1) for mark in FACTORS]


def damping(word: str) -> Transducer:
    """Marks hits within REACH words behind the class `word` as damped; its states are the words left."""
    arcs = {}
    for left in range(REACH + 1):
        to = max(0, left - 1)
        for x in PLAIN:
            arcs[left, x] = [("other", 0.0, REACH) if x == word else (x, 0.0, to)]
        for kind, level, mark in ALL_HITS:
            damped = "~" + mark.lstrip("~") if left else mark
            arcs[left, (kind, level, mark)] = [((kind, level, damped), 0.0, to)]
    return Transducer(0, set(range(REACH + 1)), arcs)


def targeting() -> Transducer:
    """Marks hits of a clause with a target. A target still to come is guessed; the guess must come true."""
    arcs = {}
    for state in ("none", "without", "promised", "seen"):
        for x in PLAIN:
            arcs[state, x] = [(x, 0.0, state)]
        arcs[state, "target"] = [] if state == "without" else [("other", 0.0, "seen")]
        for kind, level, mark in ALL_HITS:
            plain, marked = (kind, level, mark), (kind, level, mark if "+" in mark else mark + "+")
            arcs[state, plain] = [(plain, 0.0, "without"), (marked, 0.0, "promised")] if state == "none" else [(plain, 0.0, state)] if state == "without" else [(marked, 0.0, state)]
    return Transducer("none", {"none", "without", "seen"}, arcs)


def scoring(factors: dict[tuple[str, str], float]) -> Transducer:
    """Gives each marked hit its weight."""
    arcs = {(0, x): [(x, 0.0, 0)] for x in PLAIN}
    return Transducer(0, {0}, arcs | {(0, x): [(x, x[1] / 2 * factors[x[0], x[2]], 0)] for x in ALL_HITS})


def level_of(weight: float) -> int:
    return max(1, min(LEVELS, round(2 * weight)))


class Grammar:
    """The lexicon and the machine composed of the transducers of negation, reported speech, target and score."""

    def __init__(self, lexicon: dict[str, float], dampers: list[str] = (), factors: dict[tuple[str, str], float] | None = None):
        import ahocorasick

        self.factors = factors or {(kind, mark): f for kind in HITS for mark, f in FACTORS.items()}
        self.machine = damping("negation").compose(damping("reported")).compose(targeting()).compose(scoring(self.factors))
        hits = {w + "$": ("threat", 12) for w in THREATS} | {w: ("threat" if " " in w else "insult", level_of(weight)) for w, weight in lexicon.items()}
        self.stems = {w: (*x, "") for w, x in hits.items()}
        classes = {w: "negation" for w in (*NEGATIONS, *dampers)} | dict.fromkeys(REPORTED, "reported") | dict.fromkeys(TARGETS, "target")
        #: first word -> [(words, class)], longest first
        self.phrases: dict[str, list] = {}
        for w, x in [(w.rstrip("$"), (*x, "")) for w, x in hits.items() if " " in w] + [(w, c) for w, c in classes.items() if " " in w]:
            parts = WORD.findall(w)
            self.phrases.setdefault(parts[0], []).append((parts, x))
        for found in self.phrases.values():
            found.sort(key=lambda x: -len(x[0]))
        self.classes = {w: c for w, c in classes.items() if " " not in w}
        #: finds where a clause has to be read at all
        self.automaton = ahocorasick.Automaton()
        for stem in self.stems:
            plain = stem.rstrip("$")
            self.automaton.add_word(plain, self.automaton.get(plain, (len(plain), True))[:1] + (stem[-1] == "$" and self.automaton.get(plain, (0, True))[1],))
        self.automaton.make_automaton()

    def hits(self, text: str) -> list[int]:
        """Starts of insults and threats in a lower-case text, in order."""
        found = set()
        if len(self.automaton):
            for last, (length, whole) in self.automaton.iter(text):
                at = last + 1 - length
                if not (at > 0 and text[at - 1].isalpha() or whole and last + 1 < len(text) and text[last + 1].isalpha()):
                    found.add(at)
        return sorted(found)

    def steps(self, words: list[str]) -> list[list]:
        """The lexicon transducer: the classes of each word or phrase."""
        out, i = [], 0
        while i < len(words):
            phrase = next((x for x in self.phrases.get(words[i], ()) if words[i : i + len(x[0])] == x[0]), None)
            if phrase:
                out.append([phrase[1]])
                i += len(phrase[0])
                continue
            hit = max((self.stems[s] for s in (words[i], *stems_of(words[i])) if s in self.stems), key=lambda x: x[1], default=None)
            own = [x for x in (hit, self.classes.get(words[i])) if x]
            out.append(own or ["other"])
            i += 1
        return out

    def clauses(self, text: str) -> list[tuple[int, int, float, list]]:
        """(start, end, score, marked hits) of each clause that holds an insult or threat, in order."""
        text, out = text.lower(), []
        for at in self.hits(text):
            if out and at < out[-1][1]:
                continue
            before = max(text.rfind(c, 0, at) for c in ".!?;\n|") + 1
            after = CLAUSE_END.search(text, at)
            end = after.start() if after else len(text)
            score, path = self.machine.best_path(self.steps(WORD.findall(text, before, end)))
            out.append((before, end, score, [x for x in path if isinstance(x, tuple)]))
        return out

    def before_hits(self, text: str) -> set[tuple[str, int]]:
        """(word, place) of words within REACH before an insult or threat, in the same clause, that have no class yet; place tells their neighbours."""
        text, out = text.lower(), set()
        for start, end, _, _ in self.clauses(text):
            steps, words = [], WORD.findall(text, start, end)
            for i, w in enumerate(words):
                steps.append(any(isinstance(x, tuple) for x in self.steps([w])[0]))
            around = ["", *words, ""]
            for i in range(len(words)):
                near = next((j for j in range(i + 1, min(i + REACH, len(words) - 1) + 1) if steps[j]), None)
                if near is not None and not steps[i] and words[i] not in self.classes:
                    out.add((words[i], hash_pair(around[i], around[near + 2])))
        return out

    def masses(self, text: str) -> dict[tuple[str, str], float]:
        """Strength of the marked hits by (kind, mark)."""
        out: dict[tuple[str, str], float] = {}
        for _, _, _, path in self.clauses(text):
            for kind, level, mark in path:
                out[kind, mark] = out.get((kind, mark), 0.0) + level / 2
        return out

    def score(self, text: str) -> float:
        return sum(c[2] for c in self.clauses(text))


MARKS = [(kind, mark) for kind in HITS for mark in FACTORS]


def fit_line(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """(slope, intercept) of a logistic line by Newton steps."""
    design = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        h = design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(2)
        step = np.linalg.solve(h, design.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def log_likelihood(x: np.ndarray, y: np.ndarray) -> float:
    slope, intercept = fit_line(x, y)
    z = slope * x + intercept
    return float((y * z - np.logaddexp(0, z)).sum())


def fit_factors(masses: np.ndarray, y: np.ndarray) -> dict[tuple[str, str], float]:
    """(kind, mark) -> factor: for each mark with LEAST_MARKED rows the step that makes the labels likeliest, in turns."""
    factors = np.array([FACTORS[mark] for _, mark in MARKS])
    enough = (masses > 0).sum(axis=0) >= LEAST_MARKED
    for _ in range(2):
        for i in np.flatnonzero(enough):
            if MARKS[i] == ("insult", ""):
                continue  # the unit
            tried = []
            for step in FACTOR_STEPS:
                with_step = factors.copy()
                with_step[i] = step
                tried.append((log_likelihood(np.log1p(masses @ with_step), y), -abs(step - factors[i]), step))
            factors[i] = max(tried)[2]
    return dict(zip(MARKS, factors.tolist(), strict=True))


class Model:
    """What is learned: lexicon, damping words, factors of the marks, and the line."""

    def __init__(self, lexicon=None, dampers=(), factors=None, slope: float = 0.0, intercept: float = -2.0):
        self.lexicon, self.dampers, self.factors, self.slope, self.intercept = lexicon or {}, list(dampers), factors, slope, intercept

    def grammar(self) -> Grammar:
        return Grammar(self.lexicon, self.dampers, self.factors)

    def logit(self, raw: str):
        return F.lit(self.slope) * F.col(raw) + F.lit(self.intercept)


def raw_scores(rows: DataFrame, model: Model, keep: list[str], name: str = "raw") -> DataFrame:
    """The columns `keep` of rows (which must hold text) and `name`, the sum over clauses, squashed by log1p."""
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = model.grammar()
        for batch in batches:
            raw = pa.array([math.log1p(max(0.0, grammar.score(t.as_py() or ""))) for t in batch.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], raw], [*keep, name])

    return map_batches(rows, run, schema)


def marked(rows: DataFrame, model: Model) -> DataFrame:
    """label and the masses of MARKS of each of rows (text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = model.grammar()
        for batch in batches:
            found = [grammar.masses(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([[m.get(x, 0.0) for x in MARKS] for m in found], pa.list_(pa.float64()))], ["label", "masses"])

    return map_batches(rows.select("text", "label"), run, "label int, masses array<double>")


def train(labelled: DataFrame) -> Model:
    """The model of labelled (doc_id, text, label); their number is bounded (training_rows)."""
    rows = staged(labelled.select("text", F.col("label").cast("int").alias("label")), "toxic-train")
    lexicon = learn_lexicon(rows)
    model = Model(lexicon, learn_dampers(rows, lexicon) if lexicon else ())
    points = marked(rows, model).toPandas()  # training_rows' bound
    if points.empty or points["label"].nunique() < 2:
        return model
    masses, y = np.array(points["masses"].tolist(), dtype=float), points["label"].to_numpy(float)
    model.factors = fit_factors(masses, y)
    x = np.log1p(masses @ np.array([model.factors[m] for m in MARKS]))
    model.slope, model.intercept = fit_line(x, y)
    # without an insult or threat nothing speaks against a text, however common the label is
    model.intercept = min(model.intercept, -0.1)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, label: at most `sample` rows with crc32(doc_id) % 5 != 0, in hash order.

    A row an id, however often documents or labels repeat it: the largest label, and the first of its texts in order.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label is not null and not " + HELD_OUT)
    chosen = ids.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    met = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # `sample` rows at most
    return met.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


HELD_OUT = "(coalesce(crc32(cast(doc_id as string)) % 5, 1) = 0)"


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs; labels: doc_id, toxic."""
    model = train(training_rows(docs, labels, sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    score = 1 / (1 + F.exp(-model.logit("raw")))
    out = raw_scores(rows, model, ["doc_id"]).select("doc_id", F.expr(HELD_OUT).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs without those scored 0.5 or more, with the columns of docs."""
    model, name = train(training_rows(docs, labels, sample)), free_name(docs, "raw")
    raw = raw_scores(docs.withColumn("text", F.col("text").cast("string")), model, docs.columns, name)
    return raw.where(model.logit(name) < 0).select(*docs.columns)


def op9_pattern_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
