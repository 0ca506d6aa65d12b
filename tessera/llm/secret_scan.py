"""Secret scanning: candidates by pattern, false positives removed by a random forest. DataFrame and SQL functions only.

A candidate is a run of at least `LEAST` letters, digits, + / _ - that holds a digit, a capital after a small letter, or that
many capitals; any run of `LEAST_NAMED` signs or more behind a word for a secret and = or : (up to the closing quote, or
without the punctuation at its end); and the password of an address (scheme://user:password@host), however short. What it is
made of and what stands around it gives the features: its length, how often the class of character changes along it, shares of
digits and of hexadecimal digits, how many distinct characters it has, how much of it dictionary words cover, whether it
starts like a known kind of key, whether it looks like a path, whether the path of its document is one of tests or examples,
and whether the words before it name a secret, a checksum or a number of another kind, and what joins them to it. White space
ends a candidate, so a passphrase of several words is judged by its first.

The forest is grown on the driver from labelled findings: a table of a few thousand rows, made by SQL from templates of real
and harmless candidates in contexts, with features by the same expressions. Each tree is compiled into nested CASE
columns; scoring is a column expression over an array of structs within the row, so no candidate is shuffled, and a document
with many candidates is just a longer array.

Defined results: null and empty texts have no candidates and stay as they are. Repeated rows are scanned each. Ties in a
split go to the earlier feature and the smaller threshold. A null path counts as no path.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

LEAST, LEAST_NAMED = 16, 6
TREES, DEPTH, FINDINGS, SEED = 25, 6, 4000, 11
THRESHOLD = 0.5
MASK = "[SECRET]"

# Beginnings that issuers give their keys, and words that go with secrets, checksums and other numbers.
PREFIXES = "AKIA|ASIA|ghp_|gho_|github_pat_|sk_live_|rk_live_|sk-|xox[abpr]-|eyJ|AIza|glpat-|npm_|SG"
SECRET_WORDS = "passwor[dt]|passwd|pwd|passphrase|secret|token|api[_-]?key|apikey|access[_-]?key|auth|bearer|credential|private[_-]?key|signature[_-]?key|client[_-]?secret"
_JOINED = r"[=:]\s{0,2}(?:(?i:bearer|basic|token)\s{1,2})?[\"'`]?"
_NAMED = (
    rf"(?<=[=:\"'`]|[=:]\s{{1,2}}|(?:[eE][rR]|[iI][cC]|[eE][nN])\s{{1,2}})(?<={_JOINED})(?<=(?i:{SECRET_WORDS.replace('auth|', 'auth(?!or(?!i[sz]))|')})[A-Za-z0-9_\-]{{0,40}}[\"'`]?\s{{0,2}}{_JOINED})(?!(?i:bearer|basic|token)\s)"
    r"(?:(?<=\")[^\s\"]{6,}|(?<=')[^\s']{6,}|(?<=`)[^\s`]{6,}|(?<![\"'`])(?![\"'`=:])\S{5,}[^\s.,;:)\]}>\"'`])"
)
_LOGIN = r"(?<=:)(?<=[A-Za-z][A-Za-z0-9+.\-]{0,15}://[^\s:/@]{0,128}:)[^\s/]+(?=@)"
_RUN = r"(?=[A-Za-z0-9+/_\-]{16})(?=[A-Za-z+/_\-]*[0-9]|[A-Z]{16}|[A-Z+/_\-]*[a-z][a-z+/_\-]*[A-Z])[A-Za-z0-9+/_\-]{16,}"
CANDIDATE = rf"(?<![A-Za-z0-9+/_\-])(?:{_LOGIN}|{_NAMED}|{_RUN})"
SUM_WORDS = "sha-?1|sha-?256|sha-?384|sha-?512|md5|checksum|digest|commit|revision|blob|tree|etag|fingerprint|integrity|uuid|guid|build|hash|public|ssh-rsa|ssh-dss|ssh-ed25519|ecdsa-sha2-nistp\\d+|base64"
#: Beginnings of what is public: named checksums, and keys in the form that servers list.
PUBLIC = r"(?i:sha(?:1|224|256|384|512)|md5)[-_:]|AAAA[A-Z][0-9][A-Za-z]{2}"
NUMBER_WORDS = "isbn|iban|card|phone|tel|order|invoice|account|doi|serial|tracking|version|issn|ean"
PLACE_PATHS = "test|example|sample|fixture|mock|doc|demo"
DICTIONARY = (
    "access account action admin allow alpha application archive array assets backup banner base basic batch beta block body branch browser bucket "
    "buffer build button bytes cache call chain change class client cloud code color column command common compile component config connection "
    "console content context control count create current custom data database date debug default delete demo deploy design detail device direct "
    "display document domain download driver dummy editor element email enable engine entry error event example export external factory feature "
    "field file filter final folder format frame function global graph group handler header height helper here history home host html http https "
    "image import index info input install instance internal item java json just kernel key label language latest layer layout level library "
    "license line link list load local lock login long main manager map master media memory menu message meta method middle mobile model module "
    "monitor month name native network node note null number object offset online open option order output package page panel parameter parse part "
    "password path pattern pipeline placeholder platform player plugin point policy port position post prefix preview print private process product profile "
    "program project property proxy public query queue random range reader record region release remote render report request reset resource "
    "response result return role root route rule sample schema screen script search secret section select sequence server service session "
    "setting setup shared simple single size socket source stack standard start state static status storage store stream string style submit "
    "success suite support switch system table target task template test text theme thread time title token tool total track transfer tree type "
    "union update upload user util value variable vector version video view virtual wait watch web width window work worker wrapper write year your zone"
).split()

_LONG = [w for w in DICTIONARY if len(w) >= 6]

#: (text around the candidate, its kind): %s stands for it. Labels: 1 a secret, 0 none.
_CONTEXTS = {
    1: [
        ("password=%s", "hex18"), ("passwd: %s", "mix20"), ('token = "%s"', "hex40"), ("secret_key='%s'", "mix40"), ("the key is %s for now", "aws"), ("to %s on", "aws"),
        ("aws_secret_access_key = %s", "mix40"), ("Authorization: Bearer %s", "mix48"), ("api_key=%s", "hex32"), ("export TOKEN=%s", "mix36"), ("use %s here", "gh"),
        ("and %s was", "stripe"), ("client_secret: %s", "mix24"), ("pwd=%s", "mix16"), ("see %s then", "slack"), ("access token %s of", "hex40"), ("password is %s and", "mix16"), ("auth %s", "hex32"),
        ("password=%s", "pass"), ("password: %s", "pass"), ('"passwd": "%s",', "pass"), ("pwd=%s", "signs"), ("db_password = '%s'", "signs"), ("secret: %s", "signs"), ("postgres://admin:%s@db", "pass"), ("https://bot:%s@host/x", "signs"),
        ('token="%s"', "letters24"), ("api_key: %s", "letters24"), ("password=%s", "letters10"), ("client_secret='%s'", "letters10"), ("Authorization: Bearer %s", "letters24"), ("use %s here", "letters24"), ("password=%s and", "small"), ("password=%s", "wordpass"), ("password=%s, then", "wordpass"), ("pwd: %s", "wordpass"), ("token='%s'", "wordpass"), ("mysql://root:%s@db/x", "wordpass"), ('passwd="%s"', "small"),
    ],
    0: [
        ("commit %s", "hex40"), ("sha256: %s", "hex64"), ("md5 %s of", "hex32"), ("checksum = %s", "hex40"), ("card %s", "digits16"), ("the %s in", "digits16"), ("call %s or", "digits18"),
        ("id %s", "uuid"), ("see %s for", "path"), ("open %s", "path"), ("the %s of", "words"), ("with %s and", "words"), ("token = your-%s", "words"), ("password=%s", "filler"), ("secret: %s", "filler"),
        ("version %s", "version"), ("on %s at", "date"), ("invoice %s", "digits18"), ("tree %s", "hex40"), ("IN %s!! THE", "capitals"), ("the %s was", "capitals"), ("blob %s", "hex64"), ("image %s", "words"), ("isbn %s", "digits16"),
        ("password: %s", "word"), ("token: %s", "word"), ("secret=%s", "word"), ('"auth": "%s"', "word"), ("password=%s", "variable"), ("token: %s", "variable"), ("password = %s", "call"), ("api_key=%s", "call"), ("password: %s", "stars"), ("secret: %s of", "prose"),
        ('integrity="%s"', "integrity"), ('"integrity": "%s",', "integrity"), ("ssh-rsa %s user@host", "sshkey"), ("ssh-ed25519 %s me@box", "sshkey"), ("data:image/png;base64,%s", "mix48"), ("main.%s.js", "hex20"), ("public key %s of", "mix40"), ("etag: %s", "hex32"), ("docker@sha256:%s", "hex64"),
        ("the token: %s was", "prose"), ("password: %s", "twowords"), ("call %s for", "camel"), ("the %s of", "camel"), ("token = %s", "camel"), ("amqp://user:%s@host", "variable"), ("see %s in", "camel"), ("new %s and", "camel"),
    ],
}


def _maker(kind: str, i: str) -> str:
    """SQL for a candidate of a kind, pseudo-random in the expression i."""
    hexes = f"sha2(concat({i}, 'h'), 256)"
    mixed = f"regexp_replace(base64(unhex(concat(sha2(concat({i}, 'm'), 256), sha2(concat({i}, 'n'), 256)))), '=', '')"
    names = ", ".join(f"'{w}'" for w in DICTIONARY[::5])
    word = lambda salt: f"element_at(array({names}), cast(pmod(hash({i}, '{salt}'), {len(DICTIONARY[::5])}) as int) + 1)"
    base32 = f"translate(upper(substring({hexes}, 1, 16)), '018', 'QXZ')"
    plain = f"translate({mixed}, '+/', 'ab')"
    only = f"translate({mixed}, '+/0123456789', 'kQwZrTpXsVmY')"
    syllable = lambda salt: f"element_at(array('ba', 'ko', 'nel', 'tri', 'mus', 'ver', 'shi', 'dan', 'gol', 'pe', 'hun', 'lar'), cast(pmod(hash({i}, '{salt}'), 12) as int) + 1)"
    small = f"concat({syllable('s')}, {syllable('t')}, {syllable('u')}, {syllable('v')})"
    sign = lambda salt: f"element_at(array('$', '!', '#', '&', '%', '*', '@x', '^', '?', '.', '~', '('), cast(pmod(hash({i}, '{salt}'), 12) as int) + 1)"
    letters = f"translate(substring({hexes}, 1, 40), '0123456789abcdef', 'THERINGSTOANDLYE')"
    return {
        "hex18": f"substring({hexes}, 1, 18)", "hex20": f"substring({hexes}, 1, 20)", "integrity": f"concat(element_at(array('sha512-', 'sha384-', 'sha256-'), cast(pmod(hash({i}, 'a'), 3) as int) + 1), {mixed}, {mixed})", "sshkey": f"concat(element_at(array('AAAAB3NzaC1yc2EAAAADAQABAAABAQ', 'AAAAC3NzaC1lZDI1NTE5AAAAI', 'AAAAE2VjZHNhLXNoYTItbmlzdHA'), cast(pmod(hash({i}, 'a'), 3) as int) + 1), {mixed})", "hex32": f"substring({hexes}, 1, 32)", "hex40": f"substring({hexes}, 1, 40)", "hex64": hexes,
        "mix16": f"substring({mixed}, 1, 16)", "mix20": f"substring({mixed}, 1, 20)", "mix24": f"substring({mixed}, 1, 24)", "mix36": f"substring({mixed}, 1, 36)", "mix40": f"substring({mixed}, 1, 40)", "mix48": f"substring({mixed}, 1, 48)",
        "aws": f"concat('AKIA', translate(upper(substring(translate({mixed}, '+/018', 'qwert'), 1, 16)), '9', '7'))",
        "gh": f"concat('ghp_', substring(translate({mixed}, '+/', 'ab'), 1, 36))", "stripe": f"concat('sk_live_', substring(translate({mixed}, '+/', 'ab'), 1, 24))", "slack": f"concat('xoxb-', substring(conv(substring({hexes}, 1, 12), 16, 10), 1, 12), '-', substring(translate({mixed}, '+/', 'ab'), 1, 24))",
        "digits16": f"concat('4', lpad(cast(pmod(xxhash64({i}), 1000000000000000) as string), 15, '7'))", "digits18": f"lpad(cast(pmod(xxhash64({i}), 1000000000000000000) as string), 18, '3')",
        "uuid": f"concat(substring({hexes}, 1, 8), '-', substring({hexes}, 9, 4), '-4', substring({hexes}, 13, 3), '-', substring({hexes}, 17, 4), '-', substring({hexes}, 21, 12))",
        "path": f"concat('/', {word('a')}, '/', {word('b')}, '/', {word('c')}, pmod(hash({i}, 'd'), 100), '/', {word('e')})",
        "words": f"concat({word('a')}, '-', {word('b')}, '-', {word('c')}, '-', pmod(hash({i}, 'd'), 1000))", "filler": f"concat({word('a')}, '_', {word('b')}, '_here_', pmod(hash({i}, 'd'), 1000))",
        "version": f"concat('release-', pmod(hash({i}, 'a'), 20), '-', {word('b')}, '-', pmod(hash({i}, 'c'), 100))", "date": f"concat('2', lpad(pmod(hash({i}, 'a'), 1000), 3, '0'), '-0', 1 + pmod(hash({i}, 'b'), 9), '-1', pmod(hash({i}, 'c'), 10), 'T0', pmod(hash({i}, 'd'), 10), '-30-00')",
        "capitals": f"substring({letters}, 1, 16 + cast(pmod(hash({i}, 'l'), 12) as int))", "base32": base32,
        "pass": f"concat(substring(concat({syllable('s')}, {syllable('t')}, {word('a')}), 1, 5 + cast(pmod(hash({i}, 'l'), 6) as int)), substring({plain}, 1, 1), pmod(hash({i}, 'd'), 1000), {syllable('w')})",
        "signs": f"concat(substring({plain}, 1, 3), {sign('x')}, substring({plain}, 4, 2 + cast(pmod(hash({i}, 'l'), 5) as int)), {sign('y')}, substring({plain}, 12, 3), pmod(hash({i}, 'd'), 100), {sign('z')}, substring({plain}, 20, 2))",
        "letters24": f"substring({only}, 1, 16 + cast(pmod(hash({i}, 'l'), 12) as int))", "letters10": f"substring({only}, 1, 8 + cast(pmod(hash({i}, 'l'), 6) as int))", "small": small,
        "wordpass": f"concat({word('a')}, pmod(hash({i}, 'd'), 100), if(pmod(hash({i}, 'e'), 3) = 0, '', {word('b')}))",
        "word": "element_at(array({}), cast(pmod(hash({}, 'a'), {}) as int) + 1)".format(", ".join(f"'{w}'" for w in _LONG), i, len(_LONG)), "prose": f"concat({syllable('s')}, {syllable('t')}, {syllable('u')})",
        "variable": f"concat(element_at(array('${{', '$', '{{{{', '<', '%'), cast(pmod(hash({i}, 'b'), 5) as int) + 1), upper({word('a')}), '_', upper({word('c')}), element_at(array('}}', '', '}}}}', '>', '%'), cast(pmod(hash({i}, 'b'), 5) as int) + 1))",
        "call": f"concat({word('a')}, '.get_', {word('b')}, '(', {word('c')}, ')')", "stars": f"repeat(element_at(array('*', 'x', 'X', '-', '_'), cast(pmod(hash({i}, 'a'), 5) as int) + 1), 6 + cast(pmod(hash({i}, 'l'), 8) as int))",
        "twowords": f"concat({word('a')}, '_', {word('b')})", "camel": f"concat({word('a')}, initcap({word('b')}), initcap({word('c')}), initcap({word('e')}), initcap({word('g')}), 'Id')",
    }[kind]


def findings(spark: SparkSession, rows: int = FINDINGS, contexts_: dict | None = None) -> DataFrame:
    """Labelled findings: (text, path, label), as many of each label, each text with one candidate."""
    parts = []
    for label, contexts in (contexts_ or _CONTEXTS).items():
        for n, (around, kind) in enumerate(contexts):
            before, _, after = (x.replace("'", r"\'") for x in around.partition("%s"))
            each = -(-rows // (2 * len(contexts)))
            i = f"concat('{label}-{n}-', cast(id as string))"
            filler = f"element_at(array('', 'the ', 'set ', 'then, ', 'line. ', 'of was in '), cast(pmod(hash({i}, 'f'), 6) as int) + 1)"
            path = f"element_at(array('src/main', 'src3', 'tests/unit', 'docs/guide', '', 'src11'), cast(pmod(hash({i}, 'p'), 6) as int) + 1)"
            parts.append(spark.range(0, each, 1, 1).selectExpr(f"concat({filler}, '{before}', {_maker(kind, i)}, '{after}') as text", f"{path} as path", f"{label} as label", f"'{kind}' as kind"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


FEATURES = ("length", "changes", "digits", "hexes", "distinct", "covered", "prefix", "slashes", "test_path", "secret_word", "sum_word", "number_word", "assigned", "quoted", "capitals", "signs", "joined", "login", "public")


#: Candidates whose lengths are summed together on the way to the places of those behind them.
_STEP = 64


def _let(value: Column, f) -> Column:
    """f of a value that is computed once: what a lambda refers to would be computed for each element."""
    return F.transform(F.array(value), f)[0]


def _sum(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, x: a + x)


def _before_each(lengths: Column) -> Column:
    """The sum of what stands before each length: sums of steps first, then within a step, so that long arrays take no square of their size."""
    steps = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _STEP).cast("int")), lambda n: _sum(F.slice(lengths, n * _STEP + 1, F.lit(_STEP))))

    def within(sums: Column) -> Column:
        upto = F.transform(sums, lambda _, n: _sum(F.slice(sums, F.lit(1), n)))
        return _let(upto, lambda u: F.transform(lengths, lambda _, i: u[F.floor(i / _STEP).cast("int")] + _sum(F.slice(lengths, (i - i % _STEP + 1).cast("int"), (i % _STEP).cast("int")))))

    return _let(steps, within)


def candidates(text: Column) -> Column:
    """array<struct<value, start, before, after>>: start counts characters from 0; before and after are the text around, cut short."""
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))

    def placed(between: Column) -> Column:
        pieces = F.filter(F.arrays_zip(found.alias("value"), between.alias("left"), F.slice(between, 2, F.size(between)).alias("right")), lambda p: p["value"].isNotNull())

        def with_places(ps: Column) -> Column:
            lengths = F.transform(ps, lambda p: F.length(p["left"]) + F.length(p["value"]))
            at = _let(lengths, _before_each)
            return F.zip_with(ps, at, lambda p, n: F.struct(p["value"].alias("value"), (n + F.length(p["left"])).alias("start"), F.right(p["left"], F.lit(48)).alias("before"), F.left(p["right"], F.lit(24)).alias("after")))

        return _let(pieces, with_places)

    return F.when(text.rlike(CANDIDATE), _let(F.split(text, CANDIDATE, -1), placed))


def features(c: Column, path: Column) -> Column:
    """struct of FEATURES of one candidate."""
    v, before, after = c["value"], c["before"], c["after"]
    n = F.length(v).cast("double")
    one = lambda x: F.when(x, 1.0).otherwise(0.0)
    gone = lambda pattern: (n - F.length(F.regexp_replace(v, pattern, ""))) / n
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]+", "a"), "[A-Z]+", "B"), "[0-9]+", "1"), "[^aB1]+", "-")
    near = F.regexp_extract(before, r"(\S*\s*\S*\s*\S*)$", 1)
    words = "|".join(sorted((w for w in DICTIONARY if len(w) > 3), key=len, reverse=True))
    return F.struct(
        n.alias("length"),
        ((F.length(classes) - 1) / n).alias("changes"),
        gone("[0-9]").alias("digits"),
        gone("[0-9a-f]").alias("hexes"),
        (F.size(F.array_distinct(F.split(v, ""))) / n).alias("distinct"),
        gone(f"(?i)({words})").alias("covered"),
        one(v.rlike(f"^({PREFIXES})")).alias("prefix"),
        gone("[/_-]").alias("slashes"),
        one(F.coalesce(path, F.lit("")).rlike(f"(?i)(^|[^a-z])({PLACE_PATHS})")).alias("test_path"),
        one(near.rlike(f"(?i)({SECRET_WORDS})")).alias("secret_word"),
        one(near.rlike(f"(?i)(^|[^a-z])({SUM_WORDS})([^a-z]|$)")).alias("sum_word"),
        one(near.rlike(f"(?i)(^|[^a-z])({NUMBER_WORDS})([^a-z]|$)")).alias("number_word"),
        one(before.rlike(r"[=:]\s*[\"']?$")).alias("assigned"),
        one(after.rlike("^[\"']")).alias("quoted"),
        gone("[A-Z]").alias("capitals"),
        gone(r"[^A-Za-z0-9+/_\-]").alias("signs"),
        one(before.rlike(r"[=:][\"'`]?$")).alias("joined"),
        one(before.rlike(r"://[^\s:/@]*:$") & after.rlike("^@")).alias("login"),
        one(v.rlike(f"^(?:{PUBLIC})")).alias("public"),
    )


@dataclass
class Node:
    share: float
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> Node:
    """A tree by Gini impurity; each split looks at a random part of the features."""
    node = Node(float(y.mean()))
    if depth == 0 or len(y) < 8 or node.share in (0.0, 1.0):
        return node
    best = (node.share * (1 - node.share) * len(y) - 1e-9, -1, 0.0)
    for f in sorted(rng.choice(x.shape[1], 5, replace=False)):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        ones = np.cumsum(t)[cut]
        left, right = cut + 1.0, len(y) - cut - 1.0
        cost = ones * (1 - ones / left) + (y.sum() - ones) * (1 - (y.sum() - ones) / right)
        k = int(cost.argmin())
        if cost[k] < best[0]:
            best = (float(cost[k]), int(f), round(float((v[cut[k]] + v[cut[k] + 1]) / 2), 6))
    if best[1] < 0:
        return node
    side = x[:, best[1]] <= best[2]
    if side.all() or not side.any():
        return node
    node.feature, node.threshold = best[1], best[2]
    node.low, node.high = _grow(x[side], y[side], rng, depth - 1), _grow(x[~side], y[~side], rng, depth - 1)
    return node


def grow_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Node]:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(_grow(x[rows], y[rows], rng, depth))
    return out


def tree_score(node: Node, x) -> float:
    while node.low is not None:
        node = node.low if x[node.feature] <= node.threshold else node.high
    return node.share


def forest_score(forest: list[Node], f: Column) -> Column:
    """The mean share of the forest's leaves as a column over a struct of FEATURES."""

    def tree(node: Node) -> Column:
        if node.low is None:
            return F.lit(round(node.share, 6))
        return F.when(f[FEATURES[node.feature]] <= node.threshold, tree(node.low)).otherwise(tree(node.high))

    return functools.reduce(lambda a, b: a + b, map(tree, forest)) / F.lit(float(len(forest)))


_FORESTS: dict[tuple, list[Node]] = {}


def train(spark: SparkSession, rows: int = FINDINGS) -> list[Node]:
    """The forest of the labelled findings; the same for every run, and kept for the process."""
    key = (rows, TREES, DEPTH, SEED)
    if key not in _FORESTS:
        made = findings(spark, rows).repartition(4).withColumn("c", F.element_at(candidates(F.col("text")), 1)).where("c is not null").select("text", "label", features(F.col("c"), F.col("path")).alias("f")).select("text", "label", "f.*")
        got = made.collect()
        got.sort(key=lambda r: (r["label"], r["text"]))
        x = np.array([[r[n] for n in FEATURES] for r in got], float)
        _FORESTS[key] = grow_forest(x, np.array([r["label"] for r in got], float))
    return _FORESTS[key]


def scan(docs: DataFrame, forest: list[Node], *, text: str = "text", path: str | None = None, column: str = "findings") -> DataFrame:
    """docs and, as the last column, array<struct<value, start, score, secret>>, empty where nothing was found.

    Its name has underscores put before it where docs has a column of that name.
    """
    c, column = fresh(docs, "candidates_", column)
    where = F.col(path) if path else F.lit("")
    found = docs.withColumn(c, candidates(F.col(text)))
    seen = F.transform(F.col(c), lambda x: F.struct(x["value"].alias("value"), x["start"].alias("start"), features(x, where).alias("f")))
    scored = F.transform(seen, lambda x: F.struct(x["value"].alias("value"), x["start"].alias("start"), forest_score(forest, x["f"]).alias("score")))
    none = F.array().cast("array<struct<value:string,start:int,score:double,secret:boolean>>")
    judged = F.transform(scored, lambda x: F.struct(x["value"].alias("value"), x["start"].alias("start"), F.round(x["score"], 6).alias("score"), (x["score"] >= THRESHOLD).alias("secret")))
    return found.withColumn(column, F.coalesce(judged, none)).drop(c)


def redacted(text: Column, found: Column) -> Column:
    """The text with a mask for each secret among its findings, which are all that scan found, in the order of their places."""
    shown = F.transform(found, lambda x: F.when(x["secret"], F.lit(MASK)).otherwise(x["value"]))
    put = F.array_join(F.zip_with(F.split(text, CANDIDATE, -1), shown, lambda left, x: F.concat(left, F.coalesce(x, F.lit("")))), "")
    return F.when(F.exists(found, lambda x: x["secret"]), put).otherwise(text)


def findings_of(scanned: DataFrame, *, doc_id: str = "doc_id", column: str | None = None) -> DataFrame:
    """One row for each candidate of the column, the last by default: doc_id, start, length, score, secret, and a digest in place of the value."""
    column = column or scanned.columns[-1]
    (x,) = fresh(scanned, "finding_")
    rows = scanned.select(F.col(doc_id).alias("doc_id"), F.explode(column).alias(x))
    v = F.col(f"{x}.value")
    return rows.select("doc_id", F.col(f"{x}.start").alias("start"), F.length(v).alias("length"), F.sha2(v, 256).alias("value_sha256"), F.col(f"{x}.score").alias("score"), F.col(f"{x}.secret").alias("secret"))
