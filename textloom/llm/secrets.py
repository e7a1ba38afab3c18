"""Secret scans: a random forest over text candidates, evaluated as plain SQL.

A run is a maximal sequence of ``A-Z a-z 0-9 _ + / = -``; its value is what follows a leading ``name=``. A candidate is a run whose value has LEAST (6)
characters or more and that has 16 characters or more, or a digit in the value, or a name, or a word of credentials among the two runs before it. So a
single digit or a short word is never redacted, and there is no upper limit. Features are the value's length, character transitions (``weights_of``), changes
between character classes, share of digits and of capitals, dictionary coverage, words of the path (the source), and the two neighbouring words before it together with the name. The
forest is trained on the driver from labelled findings and compiled to CASE expressions, so the scan is one pass of DataFrame functions: no Python on
executors, no shuffle.

``labelled_findings`` makes a fixed seeded set of true and false findings: key formats of several kinds, and the usual false positives (long
words in several languages and cases, card and phone numbers, dates, checksums, placeholders, paths, repeated characters, long blobs). A user's own labelled findings go to
``train``.

Null and empty texts have no candidates. A null source counts as an empty path, a null doc_id is returned as null. Equal candidates of one text are
separate findings; repeated rows are scanned each. Very long texts are scanned whole, within their row. Empty tables give no rows. Extra columns are ignored by
``findings`` and kept by ``redact``, whatever their names. ``redact`` replaces at the places found and nowhere else.
"""

from __future__ import annotations

import random
import re
from functools import cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREES, DEPTH, THRESHOLD, LEAST, LONG = 15, 6, 0.5, 6, 16
REPLACEMENT = "[SECRET]"
# Frequent words and syllables of four languages, for coverage; words near secrets, near false findings, and in paths of examples.
DICTIONARY = "tion ment heit keit lich ung sch ing the and for ver ent ant que ado cion eau aux elle ere tre est ist ein ber ach ier ous able ness less ter per pro con com int ess ion her hat eth ate ion end nde ith ion es en er an on re in th at he ou ha st nd or le ai oi de ie ge be pf te zu au el la do ga mi ra ja bo as al os ll co ci ue rr ez oi on vi pa ch wh sh ly ea ti nt ble".split()
NEAR = "password passwd pwd secret token apikey api_key access_key accesskey auth bearer credential credentials private key".split()
FALSE_NEAR = "commit sha sha1 sha256 md5 hash checksum digest uuid guid phone tel card isbn revision etag".split()
FALSE_PATH = "test tests example examples sample samples mock fixture fixtures docs doc demo".split()
FEATURES = ("chars", "moves", "changes", "digits", "capitals", "covered", "path", "near", "false_near")

_RUN = "[A-Za-z0-9_+/=-]+"
_CANDIDATE = "[A-Za-z0-9_+/=-]{%d,}" % LEAST
#: Classes of characters: vowels, other small letters, capitals, digits, marks.
_CLASSES = ("aeiou", "bcdfghjklmnpqrstvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "_+/=-")
_FROM, _TO = "".join(_CLASSES), "".join(str(k) * len(c) for k, c in enumerate(_CLASSES))
_TRANSLATE = str.maketrans(_FROM, _TO)


def _word(words: list[str]) -> str:
    return "(^|[^a-z0-9])(" + "|".join(words) + ")($|[^a-z0-9])"


_DICTIONARY = "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w)))
_NAME = "^[A-Za-z_-]+="


def feature_sql(value: str, context: str, path: str, replace, moves) -> dict[str, str]:
    """SQL of each feature. replace(text, pattern, with): all matches, in the dialect; moves(classes): thousandths of the sum of their transitions' weights."""
    n = f"greatest(length({value}), 1)"
    runs = replace(replace(replace(value, "[0-9]+", "#"), "[a-z]+", "%"), "[A-Z]+", "&")
    hit = lambda text, words: f"(CASE WHEN length({replace(f'lower({text})', _word(words), '')}) < length({text}) THEN 1.0 ELSE 0.0 END)"
    left = lambda text, pattern: f"length({replace(text, pattern, '')})"
    share = lambda text, pattern: f"(1.0 - cast({left(text, pattern)} AS double) / {n})"
    return {
        "chars": f"cast(length({value}) AS double)",
        "moves": f"(cast({moves(f"translate({value}, '{_FROM}', '{_TO}')")} AS double) / {n})",
        "changes": f"(cast(length({runs}) AS double) / {n})",
        "digits": share(value, "[0-9]"),
        "capitals": share(value, "[A-Z]"),
        "covered": share(f"lower({value})", _DICTIONARY),
        "path": hit(path, FALSE_PATH),
        "near": hit(context, NEAR),
        "false_near": hit(context, FALSE_NEAR),
    }


def weights_of(labelled: list[tuple[str, str, str, int]]) -> list[int]:
    """Log odds, in thousandths, of each of the 25 transitions between character classes in secrets against other findings."""
    counts = np.ones((2, 25))
    for candidate, _, _, label in labelled:
        c = re.sub(_NAME, "", candidate).translate(_TRANSLATE)
        np.add.at(counts[label], [5 * int(x) + int(y) for x, y in zip(c, c[1:])], 1 / len(c))
    odds = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    return np.round(1000 * odds).astype(int).tolist()


def features_of(candidate: str, before: str, path: str, weights: list[int]) -> list[float]:
    """The same features in Python, for training."""
    value = re.sub(_NAME, "", candidate)
    context = f"{before} {candidate[: len(candidate) - len(value)]}"
    n = max(len(value), 1)
    runs = re.sub("[A-Z]+", "&", re.sub("[a-z]+", "%", re.sub("[0-9]+", "#", value)))
    hit = lambda t, words: float(bool(re.search(_word(words), t.lower())))
    classes = value.translate(_TRANSLATE)
    moves = sum(weights[5 * int(x) + int(y)] for x, y in zip(classes, classes[1:]))
    return [float(len(value)), moves / n, len(runs) / n, 1 - len(re.sub("[0-9]", "", value)) / n, 1 - len(re.sub("[A-Z]", "", value)) / n, 1 - len(re.sub(_DICTIONARY, "", value.lower())) / n, hit(path, FALSE_PATH), hit(context, NEAR), hit(context, FALSE_NEAR)]


def is_candidate(candidate: str, before: str) -> bool:
    value = re.sub(_NAME, "", candidate)
    return len(value) >= LEAST and (len(candidate) >= LONG or bool(re.search("[0-9]", value)) or len(value) < len(candidate) or bool(re.search(_word(NEAR), before.lower())))


def labelled_findings(n: int = 3000, seed: int = 17) -> list[tuple[str, str, str, int]]:
    """(candidate, two words before, path, label) examples: 1 is a secret."""
    r = random.Random(seed)
    hexes, upper, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda letters, k: "".join(r.choices(letters, k=k))
    word = lambda lo, hi: "".join(r.choices(DICTIONARY, k=r.randint(lo, hi)))
    plain = lambda: f"{word(1, 3)} {word(1, 3)}"
    near = lambda: r.choice((f"{word(1, 3)} {r.choice(NEAR)}", f"{r.choice(NEAR)} is", f"{r.choice(NEAR)} {word(1, 2)}"))
    path = lambda: r.choice(("", "src", "web", "crawl", f"src{r.randint(0, 99)}", f"app/{word(1, 2)}"))
    out = []
    while len(out) < n:
        kind = r.randrange(23)
        if kind < 3:
            own = ("AKIA" + draw(upper, 16), r.choice((plain, near))(), path(), 1)
        elif kind == 3:
            own = (draw(hexes, r.choice((32, 40, 40, 64))), near(), path(), 1)
        elif kind == 4:
            own = (f"{r.choice(('password', 'passwd', 'pwd', 'secret', 'token', 'api_key'))}={draw(r.choice((hexes, mixed)), r.randint(12, 24))}", plain(), path(), 1)
        elif kind == 5:
            own = (f"{r.choice(('ghp_', 'sk_live_', 'xoxb-', 'AIza'))}{draw(mixed, r.randint(24, 36))}", r.choice((plain, near))(), path(), 1)
        elif kind == 6:
            own = (draw(mixed + "+/", 40), near(), path(), 1)
        elif kind < 11:
            w = word(7, 14)[: r.randint(16, 34)]
            own = (r.choice((w, w, w.capitalize(), w.upper(), w.upper(), f"{w[:8]}-{w[8:]}", f"{w[:6]}_{w[6:]}")), r.choice((plain, plain, near))(), path(), 0)
        elif kind == 11:
            own = (draw("0123456789", r.randint(16, 19)), r.choice((plain, near))(), path(), 0)
        elif kind == 12:
            own = (draw(hexes, r.choice((32, 40, 64))), f"{word(1, 2)} {r.choice(FALSE_NEAR)}", path(), 0)
        elif kind == 13:
            own = (f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}-{draw('0123456789', 6)}", plain(), path(), 0)
        elif kind == 14:
            own = ("/".join(word(1, 3) for _ in range(6)), plain(), path(), 0)
        elif kind == 15:
            long = r.choice((r.choice(mixed) * r.randint(16, 600), draw(mixed, r.choice((1, 2, 3))) * r.randint(16, 200), draw(mixed + "+/", r.randint(300, 900))))
            own = (long, r.choice((plain, near))(), path(), 0)
        elif kind == 16:  # short passwords
            own = (r.choice((word(1, 2) + draw("0123456789", r.randint(1, 4)), draw(mixed, r.randint(8, 14)), word(1, 2).capitalize() + draw("0123456789", 2) + r.choice("_+-="))), near(), path(), 1)
        elif kind == 17:
            own = (f"{r.choice(('password', 'passwd', 'pwd', 'secret'))}={r.choice((word(1, 2) + draw('0123456789', r.randint(1, 4)), draw(mixed, r.randint(6, 12))))}", plain(), path(), 1)
        elif kind == 18:  # short words with digits that are no secrets
            own = (r.choice((word(2, 3) + draw("0123456789", r.randint(1, 2)), f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{draw('0123456789', 3)}-{draw('0123456789', 4)}", draw("0123456789", r.randint(6, 15)), f"{draw('0123456789', 2)}/{draw('0123456789', 2)}/{draw('0123456789', 4)}", f"+{draw('0123456789', r.randint(8, 12))}", f"{draw('0123456789', 4)}-{draw('0123456789', 4)}-{draw('0123456789', 4)}-{draw('0123456789', 4)}")), plain(), path(), 0)
        elif kind in (19, 20):  # plain words after a word of credentials
            own = (r.choice((word(2, 5), word(2, 4).capitalize(), f"{word(1, 2)}-{word(1, 2)}")), near(), path(), 0)
        elif kind == 21:
            own = (r.choice((f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", draw("0123456789", r.randint(6, 19)))), near(), path(), 0)
        else:
            fake = r.choice((draw("x", 20), draw("X", 24), "password=" + draw("x*"[0], 12), "token=" + word(6, 8)[:16], draw(mixed, 32), "AKIA" + draw(upper, 16)))
            own = (fake, r.choice((plain, near))(), r.choice(("tests/unit", "docs/example", "sample", "demo/fixtures")), 0)
        if is_candidate(own[0], own[1]):
            out.append(own)
    return out


def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng) -> tuple | float:
    if depth == 0 or len(y) < 8 or y.min() == y.max():
        return round(float(y.mean()), 4)
    best = None
    for f in rng.choice(x.shape[1], 4, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(np.diff(v) > 1e-3)
        if not len(cut):
            continue
        left = cut + 1.0
        p, q = t[cut] / left, (t[-1] - t[cut]) / (len(y) - left)
        loss = left * p * (1 - p) + (len(y) - left) * q * (1 - q)
        k = int(np.argmin(loss))
        if best is None or loss[k] < best[0]:
            best = (loss[k], f, round(float(v[cut[k]] + v[cut[k] + 1]) / 2, 4))
    if best is None:
        return round(float(y.mean()), 4)
    _, f, at = best
    low = x[:, f] <= at
    return (int(f), at, _grow(x[low], y[low], depth - 1, rng), _grow(x[~low], y[~low], depth - 1, rng))


class Forest(NamedTuple):
    weights: list[int]
    trees: list


def train(labelled: list[tuple[str, str, str, int]], trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> Forest:
    """Trees as nested (feature, threshold, at most, above) with probabilities at the leaves, and the weights of transitions."""
    weights = weights_of(labelled)
    x = np.array([features_of(*own[:3], weights) for own in labelled])
    y = np.array([float(own[3]) for own in labelled])
    rng = np.random.Generator(np.random.PCG64(seed))
    return Forest(weights, [_grow(x[pick], y[pick], depth, rng) for pick in (rng.integers(0, len(y), len(y)) for _ in range(trees))])


def score_of(forest: Forest, candidate: str, before: str, path: str) -> float:
    features = features_of(candidate, before, path, forest.weights)

    def leaf(node):
        while not isinstance(node, float):
            node = node[2] if features[node[0]] <= node[1] else node[3]
        return node

    return sum(map(leaf, forest.trees)) / len(forest.trees)


def forest_sql(forest: Forest, column) -> str:
    """The forest's score as SQL; column(feature name) gives a feature."""

    def case(node):
        return f"{node!r}" + "D" * column.spark if isinstance(node, float) else f"(CASE WHEN {column(FEATURES[node[0]])} <= {node[1]!r} THEN {case(node[2])} ELSE {case(node[3])} END)"

    return f"round(({' + '.join(map(case, forest.trees))}) / {len(forest.trees)}, 6)"


class _Column:
    def __init__(self, prefix: str, spark: bool):
        self.prefix, self.spark = prefix, spark

    def __call__(self, name: str) -> str:
        return self.prefix + name


@cache
def default_forest() -> Forest:
    return train(labelled_findings(5000))


def _spark_replace(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, '{pattern}', '{by}')"


def _spark_moves(weights: list[int]):
    array = f"array({', '.join(map(str, weights))})"
    code = lambda k: f"(ascii(get(z, {k})) - 48)"
    return lambda classes: f"transform(array(split({classes}, '')), z -> aggregate(sequence(1, greatest(size(z) - 1, 1)), 0L, (t, k) -> t + coalesce(get({array}, 5 * {code('k - 1')} + {code('k')}), 0)))[0]"


def tokens_expr(text: str) -> str:
    """SQL of the runs of a text and what lies between them, by turns; together they are the text."""
    return f"regexp_extract_all({text}, '{_RUN}|[^A-Za-z0-9_+/=-]+', 0)"


def scored_expr(tokens: str, text: str, path: str, forest: Forest) -> str:
    """SQL of the candidates among a text's tokens (an identifier): array of (i, value, score), in order; i is the token's index."""
    before = lambda s: f"concat(coalesce(get({tokens}, {s}.i - 4), ''), ' ', coalesce(get({tokens}, {s}.i - 2), ''))"
    held = f"filter(transform({tokens}, (w, i) -> named_struct('w', w, 'i', i)), s -> length(s.w) >= {LEAST} AND s.w rlike '^{_RUN}$')"
    valued = f"transform({held}, s -> named_struct('w', s.w, 'i', s.i, 'value', regexp_replace(s.w, '{_NAME}', '')))"
    credentials = f"lower({text}) rlike '{_word(NEAR)}'"
    candidate = f"length(s.value) >= {LEAST} AND (length(s.w) >= {LONG} OR s.value rlike '[0-9]' OR length(s.value) < length(s.w) OR (near_ AND lower({before('s')}) rlike '{_word(NEAR)}'))"
    chosen = f"transform(array({credentials}), near_ -> filter({valued}, s -> {candidate}))[0]"
    told = f"transform({chosen}, s -> named_struct('i', s.i, 'value', s.value, 'context', concat({before('s')}, ' ', substring(s.w, 1, length(s.w) - length(s.value)))))"
    fs = feature_sql("s.value", "s.context", f"coalesce({path}, '')", _spark_replace, _spark_moves(forest.weights))
    measured = f"transform({told}, s -> named_struct('i', s.i, 'value', s.value, " + ", ".join(f"'{k}', {v}" for k, v in fs.items()) + "))"
    return f"transform({measured}, s -> named_struct('i', s.i, 'value', s.value, 'score', {forest_sql(forest, _Column('s.', True))}))"


def findings_expr(text: str, path: str, forest: Forest | None = None) -> str:
    """SQL of the candidates of a text column: array of (i, value, score), in order."""
    found = f"transform(array({tokens_expr(text)}), t_ -> {scored_expr('t_', text, path, forest or default_forest())})[0]"
    return f"CASE WHEN {text} rlike '{_CANDIDATE}' THEN {found} ELSE cast(array() AS array<struct<i:int,value:string,score:double>>) END"


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", forest: Forest | None = None) -> DataFrame:
    """One row per candidate: doc_id, n (from 1), value, score, is_secret."""
    bare = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text_"), F.col(path_col).alias("path_"))
    found = bare.select("doc_id", F.posexplode(F.expr(findings_expr("text_", "path_", forest))).alias("n", "f"))
    return found.select("doc_id", (F.col("n") + 1).cast("int").alias("n"), F.col("f.value").alias("value"), F.col("f.score").alias("score"), (F.col("f.score") >= THRESHOLD).alias("is_secret"))


def redact(docs: DataFrame, text_col: str = "text", path_col: str | None = "source", forest: Forest | None = None) -> DataFrame:
    """docs with the value of every secret found replaced in its place in the text; other rows and columns as they are. path_col: None, or no column, is an empty path."""
    text, path = f"`{text_col}`", f"`{path_col}`" if path_col in docs.columns else "''"
    scored = scored_expr("t_", text, path, forest or default_forest())
    places = f"transform(filter({scored}, s -> s.score >= {THRESHOLD}), s -> named_struct('i', s.i, 'n', length(s.value)))"
    joined = f"array_join(transform(t_, (w, i) -> transform(array(filter(p_, s -> s.i = i)), h -> CASE WHEN size(h) = 0 THEN w ELSE concat(substring(w, 1, length(w) - h[0].n), '{REPLACEMENT}') END)[0]), '')"
    clean = f"transform(array({tokens_expr(text)}), t_ -> transform(array({places}), p_ -> CASE WHEN size(p_) = 0 THEN {text} ELSE {joined} END)[0])[0]"
    return docs.withColumn(text_col, F.expr(f"CASE WHEN {text} rlike '{_CANDIDATE}' THEN {clean} ELSE {text} END"))


def oracle_sql() -> str:
    """DuckDB SQL of ``findings`` over documents."""
    replace = lambda text, pattern, by: f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    forest = default_forest()
    moves = lambda c: f"coalesce(list_sum(list_transform(range(1, length({c})), lambda k: ([{', '.join(map(str, forest.weights))}])[1 + 5 * cast(substring({c}, k, 1) AS int) + cast(substring({c}, k + 1, 1) AS int)])), 0)"
    fs = feature_sql("value", "context", "coalesce(source, '')", replace, moves)
    near = f"regexp_matches(lower(b), '{_word(NEAR)}')"
    return f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, source, regexp_extract_all(text, '{_RUN}') AS w FROM documents WHERE text IS NOT NULL),
held AS (SELECT r, doc_id, source, w, unnest(range(1, len(w) + 1)) AS i FROM words),
runs AS (SELECT r, doc_id, source, i, w[i] AS candidate, coalesce(CASE WHEN i > 2 THEN w[i - 2] END, '') || ' ' || coalesce(CASE WHEN i > 1 THEN w[i - 1] END, '') AS b FROM held WHERE length(w[i]) >= {LEAST}),
valued AS (SELECT *, {replace("candidate", _NAME, "")} AS value FROM runs),
seen AS (SELECT r, doc_id, source, i, value, b || ' ' || substring(candidate, 1, length(candidate) - length(value)) AS context FROM valued
  WHERE length(value) >= {LEAST} AND (length(candidate) >= {LONG} OR regexp_matches(value, '[0-9]') OR length(value) < length(candidate) OR {near})),
measured AS (SELECT r, doc_id, i, value, {", ".join(f"{v} AS {k}" for k, v in fs.items())} FROM seen),
scored AS (SELECT r, doc_id, i, value, {forest_sql(forest, _Column("", False))} AS score FROM measured)
SELECT doc_id, cast(row_number() OVER (PARTITION BY r ORDER BY i) AS int) AS n, value, cast(score AS double) AS score, score >= {THRESHOLD} AS is_secret FROM scored"""
