"""Toxicity with a weighted finite-state pattern grammar.

A lexicon turns words into symbols (insult, harm, target, negation, report, intent, strength, words of phrases, other).
Five transducers then read a clause, each on the output of the one before, rewriting what it knows and passing on the rest:

* insult: phrases such as "go to hell" become an insult; a word of strength before an insult raises it;
* threat: harm becomes a threat, a stronger one after a word of intent ("will kill"), and so do phrases;
* reported speech and negation: each discounts the abuse in its reach;
* target: a target near an insult raises it, and a threat counts only with one. A target may come before or after, so
  this one reads the output of the others from both sides, and the larger sum counts.

The first four are composed, state by state as states are reached, into one transducer, which runs over every clause
with an insult, harm or a phrase; the weights of its path and of the target's multiply. So what counts is the matched
clause: "not an idiot" or "he said: idiot" weigh less than "you idiot", and "kill the process" nothing.

The weights of arcs are fixed. Insults come from a seed list and from words that labelled rows show to be typical of
toxic texts; the other symbols have seed lists only. A logistic regression on three numbers of a document (the sum of its
clause scores on a logarithmic scale, the largest, and twice the sum up to 1) makes the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.checkpointing import cut
from weft.llm._common import bound_batches, quoted, spare, table
from weft.llm.byte_cnn import held_out

INSULT, HARM, THREAT, TARGET, NEGATION, REPORT, INTENT, STRENGTH, OTHER = "IHTGNRMSO"
SEEDS = {
    INSULT: "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns imbecile vermin filth idiota estupido estúpido imbécil basura débile ordure connard abruti idiotin dummkopf abschaum dreck".split(),
    HARM: "kill hurt destroy beat punish shoot stab burn kills killing matar golpear tuer frapper töten schlagen".split(),
    TARGET: "you your yours yourself u ur they them their he him she her people everyone du dich dir ihr euch tu te toi vous usted ustedes tú".split(),
    NEGATION: "not no never isn't aren't wasn't don't doesn't didn't cannot can't nicht kein keine nie pas jamais non nunca jamás".split(),
    INTENT: "will gonna going shall must should i'll we'll werde werden vais va voy vamos".split(),
    STRENGTH: "such total totally complete completely utter utterly absolute absolutely fucking damn bloody so echt total tel muy tan".split(),
    REPORT: "said says say claimed claims called reported wrote quoted quote according alleged sagte sagt dit disait dijo dice".split(),
}
#: Phrases that are an insult or a threat as a whole.
PHRASES = {
    INSULT: ["shut up", "drop dead", "go to hell", "get lost", "piece of crap", "halt die klappe", "ferme la", "vete al diablo"],
    THREAT: ["watch your back", "you are dead", "i know where you live"],
}
#: Words learned from labels: in at least LEAST toxic texts and this share of them, and RATIO times as often there as
#: elsewhere. Rarer words go together with toxic texts by chance or by copies.
LEAST, SHARE, RATIO, LEARNED = 4, 0.008, 25.0, 2000
#: Labelled documents, by a hash of their ids, that lexicon and regression are fitted on.
FITTED = 20_000
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE_END = re.compile(r"[.!?;:\n]")
THRESHOLD = 0.7


@dataclass
class Transducer:
    """Deterministic, one output symbol for each input symbol; an arc without an entry passes its symbol on at weight 1."""

    start: str
    arcs: dict[tuple[str, str], tuple[str, float, str]] = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (symbol, 1.0, state))


@dataclass
class Composed:
    """first, then second on first's output; weights multiply. Pairs of states are made when they are first reached."""

    first: object
    second: object
    arcs: dict = field(default_factory=dict)

    @property
    def start(self):
        return (self.first.start, self.second.start)

    def step(self, state, symbol):
        if (found := self.arcs.get((state, symbol))) is None:
            middle, w1, a = self.first.step(state[0], symbol)
            out, w2, b = self.second.step(state[1], middle)
            found = self.arcs[state, symbol] = (out, w1 * w2, (a, b))
        return found


SYMBOLS = (INSULT, HARM, THREAT, TARGET, NEGATION, REPORT, INTENT, STRENGTH, OTHER)
ABUSE = (INSULT, HARM, THREAT)


def _phrases(symbol: str, last: bool) -> Transducer:
    """The last word of a phrase becomes the symbol. States are the words matched so far. Words of phrases that aren't
    complete are passed on, and by the last of these transducers turned into what they are otherwise."""
    t, phrases = Transducer(""), PHRASES[symbol]
    words = sorted({w for own in PHRASES.values() for p in own for w in p.split()})
    prefixes = {" ".join(p.split()[:n]) for p in phrases for n in range(len(p.split()))}
    for state in prefixes:
        for w in words:
            tail = [*state.split(), w]
            ends = [" ".join(tail[i:]) for i in range(len(tail))]
            done = any(x in phrases for x in ends)
            t.arcs[state, w] = (symbol if done else SYMBOL_OF.get(w, OTHER) if last else w, 1.0, "" if done else next((x for x in ends if x in prefixes), ""))
        for s in SYMBOLS:
            t.arcs[state, s] = (s, 1.0, "")
    return t


def _raised(trigger: str, abuse: str, out: str, factor: float, otherwise: float, words: int) -> Transducer:
    """Within so many words after the trigger, ``abuse`` becomes ``out`` at ``factor``; elsewhere at ``otherwise``."""
    t = Transducer("0")
    for n in range(words + 1):
        state, later = str(n), str(max(0, n - 1))
        for s in SYMBOLS:
            t.arcs[state, s] = (s, 1.0, later)
        t.arcs[state, trigger] = (OTHER, 1.0, str(words))
        t.arcs[state, abuse] = (out, factor if n else otherwise, later)
    return t


def _reach(trigger: str, factor: float, words: int) -> Transducer:
    """After the trigger, the next ``words`` symbols are in its reach: abuse there is worth ``factor``."""
    t = Transducer("0")
    for n in range(words + 1):
        state, later = str(n), str(max(0, n - 1))
        for s in SYMBOLS:
            t.arcs[state, s] = (s, factor if n and s in ABUSE else 1.0, later)
        t.arcs[state, trigger] = (OTHER, 1.0, str(words))
    return t


def _aimed(near: int = 3) -> Transducer:
    """Abuse within ``near`` words after a target is aimed, and a threat counts only so."""
    t = Transducer("0")
    for n in range(near + 1):
        state, later = str(n), str(max(0, n - 1))
        for s in SYMBOLS:
            t.arcs[state, s] = (s, 1.0, later)
        t.arcs[state, TARGET] = (TARGET, 1.0, str(near))
        t.arcs[state, INSULT] = (INSULT, 1.5 if n else 1.0, state)
        t.arcs[state, THREAT] = (THREAT if n else OTHER, 1.0, state)
    return t


@dataclass
class Grammar:
    front: Composed
    aimed: Transducer


def grammar() -> Grammar:
    insult = _phrases(INSULT, False), _raised(STRENGTH, INSULT, INSULT, 1.25, 1.0, 2)
    threat = _phrases(THREAT, True), _raised(INTENT, HARM, THREAT, 1.0, 0.6, 3)
    abuse = Composed(Composed(insult[0], threat[0]), Composed(insult[1], threat[1]))  # phrases of both, then words of both
    return Grammar(Composed(abuse, Composed(_reach(REPORT, 0.5, 12), _reach(NEGATION, 0.3, 3))), _aimed())


SYMBOL_OF = {w: s for s, words in SEEDS.items() for w in words}


def lexicon(learned: dict[str, float] | None = None) -> dict[str, tuple[str, float]]:
    """Word -> (symbol, weight). A learned insult keeps its learned weight, one that is only a seed counts 1.

    A word of a phrase is a symbol of its own, which the phrases' transducers turn into its usual one.
    """
    out = {w: (s, 1.0) for w, s in SYMBOL_OF.items()}
    for w, weight in (learned or {}).items():
        if out.get(w, (INSULT,))[0] == INSULT:
            out[w] = (INSULT, weight)
    for phrases in PHRASES.values():
        for w in {w for p in phrases for w in p.split()}:
            if out.get(w, (OTHER,))[0] not in ABUSE:
                out[w] = (w, 1.0)
    return out


#: Words by which a clause with a phrase is found: the longest of each.
_OPENERS = frozenset(max(p.split(), key=len) for phrases in PHRASES.values() for p in phrases)


def clause_scores(text: str | None, words: dict[str, tuple[str, float]], machine: Grammar) -> tuple[int, list[float]]:
    """The number of words, and the scores of clauses with abuse."""
    low = (text or "").lower()
    tokens = WORD.findall(low)
    abusive = {t for t in set(tokens) if t in words and (words[t][0] in ABUSE or t in _OPENERS)}
    if not abusive:
        return len(tokens), []
    scores = []
    at = 0
    for end in (*(m.start() for m in CLAUSE_END.finditer(low)), len(low)):
        clause = low[at:end]
        at = end + 1
        seen = WORD.findall(clause)
        if abusive.isdisjoint(seen):
            continue
        if total := _path([words.get(t, (OTHER, 1.0)) for t in seen], machine):
            scores.append(total)
    return len(tokens), scores


def _path(marked: list[tuple[str, float]], machine: Grammar) -> float:
    state, out = machine.front.start, []
    for symbol, weight in marked:
        symbol, factor, state = machine.front.step(state, symbol)
        out.append((symbol, weight * factor))
    return max(_sum(out, machine.aimed), _sum(out[::-1], machine.aimed))


def _sum(marked: list[tuple[str, float]], aimed: Transducer) -> float:
    state, total = aimed.start, 0.0
    for symbol, weight in marked:
        out, factor, state = aimed.step(state, symbol)
        if out in (INSULT, THREAT):
            total += weight * factor
    return total


def numbers(text: str | None, words: dict, machine: Grammar) -> tuple[float, float, float]:
    _, scores = clause_scores(text, words, machine)
    total = sum(scores)
    return math.log1p(total), max(scores, default=0.0), min(1.0, 2 * total)


def learn_words(sample: DataFrame) -> dict[str, float]:
    """Words typical of toxic texts, from counts of documents (text, y) of the sample. The result is bounded by LEARNED.

    Copies and near copies would make any word of a toxic text typical, so of the documents whose smallest hash of
    three words in a row is the same only one counts.
    """
    words = sample.select("y", F.xxhash64("text").alias("h"), F.regexp_extract_all(F.lower(F.col("text")), F.lit(r"\p{L}+"), 0).alias("w"))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    one = words.select("y", "h", F.array_distinct("w").alias("w"), F.array_min(runs).alias("key")).groupBy("key").agg(F.min(F.struct("h", "y", "w")).alias("d")).select("d.y", "d.w")
    toxic = F.col("y") == 1
    totals = one.agg(F.sum(F.when(toxic, 1).otherwise(0)).alias("t"), F.sum(F.when(toxic, 0).otherwise(1)).alias("c")).first()
    t, c = totals["t"] or 0, totals["c"] or 0
    if not t or not c:
        return {}
    counts = one.select(toxic.cast("long").alias("y"), F.explode("w").alias("w")).groupBy("w").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    ratio = (F.col("a") / float(t)) / ((F.col("b") + 0.5) / float(c))
    rows = counts.filter((F.col("a") >= max(LEAST, SHARE * t)) & (ratio >= RATIO)).select("w", ratio.alias("r")).orderBy(F.desc("r"), "w").limit(LEARNED).collect()
    return {r["w"]: min(2.0, math.log(r["r"]) / math.log(RATIO)) for r in rows}


@dataclass
class Scorer:
    words: dict[str, tuple[str, float]]
    weights: np.ndarray  # bias and one for each number

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)
        return 1 / (1 + np.exp(-z))


#: Used where no labels are there to fit on: one plain insult is about even.
DEFAULT = np.array([-2.0, 2.0, 1.0, 2.0])


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * len(x) / 100 * np.eye(a.shape[1])
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * len(x) / 100 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _numbers(text: Column, words: dict, spark: SparkSession) -> Column:
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("a double, b double, c double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = grammar()
        for texts in batches:
            yield pd.DataFrame([numbers(t, shared.value, machine) for t in texts], columns=["a", "b", "c"], dtype="float64")

    return of(text.cast("string"))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, bound: int = FITTED) -> DataFrame:
    """(o, y, text) of at most ``bound`` labelled ids, the first by a hash of the id; each is its largest label.

    An id of several rows counts once, with its largest text, so the sample has at most ``bound`` rows. The chosen labels
    are broadcast: two numbers for each of them.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("double").alias("y"))
    chosen = known.withColumn("o", F.xxhash64(F.lit("fit"), F.col("i").cast("string"))).orderBy("o", "i").limit(bound)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("text")).filter("text is not null")
    return cut(texts.join(F.broadcast(chosen), "i").groupBy("i", "o", "y").agg(F.max("text").alias("text")).select("o", "y", "text"), "sample")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """Lexicon and weights from a bounded sample of labelled documents."""
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, id_col, text_col, label_col)
    words = lexicon(learn_words(sample))
    x = sample.select("o", "y", F.xxhash64("text").alias("h"), _numbers(F.col("text"), words, spark).alias("n"))
    rows = x.select("y", "n.a", "n.b", "n.c", "o", "h").toPandas().sort_values(["o", "h", "y", "a"], ignore_index=True)
    if rows["y"].nunique() < 2:
        return Scorer(words, DEFAULT)
    return Scorer(words, _fit(rows[["a", "b", "c"]].to_numpy(float), (rows["y"] > 0).to_numpy(float)))


def score_toxicity(df: DataFrame, scorer: Scorer, text_col: str = "text", out: str = "_toxicity") -> DataFrame:
    """df with one more column: struct score (0 to 1), clause_sum. Null and empty texts have no clause and the least score.

    Equal texts have equal scores; repeated rows stay; other columns pass through whatever their names, but a column
    named like ``out`` is replaced. An empty table gives no rows.
    """
    bound_batches(df.sparkSession)
    w = [F.lit(float(v)) for v in scorer.weights]
    (tmp,) = spare(df, "weft_numbers")
    scored = df.withColumn(tmp, _numbers(F.col(text_col), scorer.words, df.sparkSession))
    z = w[0] + w[1] * F.col(f"{tmp}.a") + w[2] * F.col(f"{tmp}.b") + w[3] * F.col(f"{tmp}.c")
    score = F.round(1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0)))), 9)
    return scored.select(*quoted([c for c in df.columns if c != out]), F.struct(score.alias("score"), F.expm1(F.col(f"{tmp}.a")).alias("clause_sum")).alias(out))


def op5_clause_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents; null and empty texts have the least score, null ids are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out(F.col("doc_id"), 3, 1))
    bound_batches(spark)
    scorer = fit(docs, labels)
    out = score_toxicity(docs.withColumn("held_out", held_out(F.col("doc_id"), 3, 1)), scorer)
    return out.select("doc_id", "held_out", "_toxicity.score", (F.col("_toxicity.score") >= THRESHOLD).cast("int").alias("predicted"))
