"""Intents and spans of queries: features, training rows from templates, gazetteers, and a greedy tagger."""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tessera.functions import text as T
from tessera.sources.shared import if_small

# What stands between tokens (letters, digits, _ and the marks of three scripts stay), and kinds of spans.
BETWEEN = "[^\\wऀ-ॿ஀-௿ఀ-౿̀-ͯ]+"
KINDS = ("CROP", "LOC", "STAGE", "SYMPTOM")
_SPLIT = re.compile(BETWEEN)


def tokens(x: Column) -> Column:
    return F.filter(F.split(F.lower(x), f"(?U){BETWEEN}"), lambda t: t != "")


def padded_grams(word: Column, n: int) -> Column:
    """n-grams of #word$, none of a word of less than n letters."""
    return F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) + 3 - n), lambda i: F.substring(F.concat(F.lit("#"), word, F.lit("$")), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def intent_features(x: Column) -> Column:
    """w:token and, for n of 3 and 4, n:gram of each token."""
    return F.flatten(F.transform(tokens(x), lambda t: F.concat(F.array(F.concat(F.lit("w:"), t)), F.transform(padded_grams(t, 3), lambda g: F.concat(F.lit("3:"), g)), F.transform(padded_grams(t, 4), lambda g: F.concat(F.lit("4:"), g)))))


def filled(templates: DataFrame, slots: DataFrame) -> DataFrame:
    """(text, label) from templates (template, label) with {slot}s and slots (slot, value, n): all values of a template's first slot, and
    for each the values at the same place, round and round, of its others. Few rows: templates times values."""
    found = F.regexp_extract_all("template", F.lit(r"\{([a-z]+)\}"), F.lit(1))
    values = slots.groupBy("slot").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("values"))
    first = templates.withColumn("slots", F.array_distinct(found)).withColumn("slot", F.try_element_at("slots", F.lit(1)))
    each = first.join(if_small(values), "slot", "left").select("template", "label", "slots", F.posexplode_outer("values").alias("at", "value"))
    both = each.withColumn("known", values.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("slot", "values")))).scalar())
    text = F.aggregate("slots", F.col("template"), lambda t, s: F.replace(t, F.concat(F.lit("{"), s, F.lit("}")), F.coalesce(F.try_element_at(F.col("known"), s)[F.pmod(F.col("at"), F.greatest(F.size(F.try_element_at(F.col("known"), s)), F.lit(1)))], F.lit(""))))
    return both.select(text.alias("text"), "label")


def gazetteer(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From names (name, kind, ord): (token, kinds) and (phrase, kind); a phrase has the kind that named it first."""
    n = names.select(T.normalise(F.col("name")).alias("phrase"), "kind", "ord").where("phrase <> ''")
    phrases = n.groupBy("phrase").agg(F.min_by("kind", "ord").alias("kind"))
    words = n.select(F.explode(F.split("phrase", " ")).alias("token"), "kind").groupBy("token").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    return words, phrases


def spans_by_phrase(queries: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, kind, phrase): names that queries (id, query) hold as whole words, in an equi-join of word n-grams."""
    lengths = sorted(r[0] for r in phrases.select(F.size(F.split("phrase", " "))).distinct().collect())
    words = F.filter(F.split(T.normalise(F.col("query")), " "), lambda w: w != "")
    grams = F.array_distinct(F.concat(*[T.ngrams(words, n) for n in lengths])) if lengths else F.array().cast("array<string>")
    return queries.select("id", F.explode(grams).alias("phrase")).join(if_small(phrases), "phrase").select("id", "kind", "phrase")


class Tagger:
    """Greedy B/I/O tags by naive Bayes over a token, what is around it, its gazetteer kinds, and the tag before it."""

    def __init__(self, kinds: dict[str, list[str]], alpha: float = 0.5):
        self.kinds, self.alpha = kinds, alpha
        self.tags: Counter = Counter()
        self.counts: dict[str, Counter] = defaultdict(Counter)
        self.vocabulary: set[str] = set()

    def features(self, token: str, before: str, tag: str) -> list[str]:
        shape = "D" if token.isdigit() else "A" if token.isalpha() else "M"
        padded = f"#{token}$"
        out = [f"w:{token}", f"pre:{token[:3]}", f"suf:{token[-3:]}", f"prev:{before}", f"tag:{tag}", f"shape:{shape}"]
        out += [f"3:{padded[i : i + 3]}" for i in range(len(padded) - 2)] if len(token) >= 3 else []
        return out + [f"gz:{k}" for k in self.kinds.get(token, ["NONE"])]

    def learn(self, rows: list[tuple[list[str], list[str]]]) -> Tagger:
        for words, tags in rows:
            for word, tag, before, last in zip(words, tags, ["", *words], ["O", *tags], strict=False):
                found = self.features(word, before, last)
                self.tags[tag] += 1
                self.counts[tag].update(found)
                self.vocabulary.update(found)
        self.totals = {t: sum(c.values()) for t, c in self.counts.items()}
        return self

    def tag(self, words: list[str]) -> list[str]:
        out: list[str] = []
        size, all_ = len(self.vocabulary), sum(self.tags.values())
        for i, word in enumerate(words):
            last = out[-1] if out else "O"
            found = self.features(word, words[i - 1] if i else "", last)

            def score(t: str, found=found) -> float:
                low = self.totals[t] + self.alpha * size
                return math.log(self.tags[t] / all_) + sum(math.log((self.counts[t][f] + self.alpha) / low) for f in found)

            allowed = [t for t in sorted(self.tags) if not t.startswith("I-") or last[2:] == t[2:]]
            out.append(max(allowed, key=score) if allowed else "O")
        return out


def tagged_examples(templates: list[str], values: dict[str, list[str]], kinds: dict[str, str]) -> list[tuple[list[str], list[str]]]:
    """Training rows (tokens, tags) from templates with {slot}s: every combination of a template's values; kinds gives each slot's kind."""
    out = []
    for template in templates:
        parts = re.split(r"(\{[a-z]+\})", template)
        slots = list(dict.fromkeys(p[1:-1] for p in parts if p.startswith("{")))
        for chosen in itertools.product(*[values[s] for s in slots]):
            told, words, tags = dict(zip(slots, chosen, strict=True)), [], []
            for p in parts:
                own = [w for w in _SPLIT.split((told[p[1:-1]] if p.startswith("{") else p).lower()) if w]
                kind = kinds.get(p[1:-1]) if p.startswith("{") else None
                words += own
                tags += [f"{'B' if n == 0 else 'I'}-{kind}" if kind else "O" for n in range(len(own))]
            out.append((words, tags))
    return out


SPAN = StructType([StructField("kind", StringType()), StructField("text", StringType())])


def spans(tagger: Tagger, spark):
    """The tagger as a function of a text column: array<struct<kind, text>>. The model goes out once; a text is tagged word by word."""
    shared = spark.sparkContext.broadcast(tagger)

    @F.pandas_udf(ArrayType(SPAN))
    def found(x):
        def one(text):
            words = [w for w in _SPLIT.split((text or "").lower()) if w]
            out: list[list] = []
            for word, tag in zip(words, shared.value.tag(words), strict=True):
                if tag.startswith("B-"):
                    out.append([tag[2:], [word]])
                elif tag.startswith("I-") and out:
                    out[-1][1].append(word)
            return [{"kind": k, "text": " ".join(w)} for k, w in out]

        return x.map(one)

    return found
