"""Operator 5: quality rules with robust multivariate outliers, in DataFrame and SQL operations only.

Each document gets five statistics of its whole text, two plain rules (``base_failed``), and a verdict: its transformed
statistics are held against minimum-covariance-determinant estimates of its language and source.

For each source of a language, each language and the whole table, two starts (the sum of squares and the greatest of the
deviations from medians, in median deviations) choose the three quarters of the rows nearest to the centre. Concentration
steps - location and covariance of the chosen rows, distances of all, the nearest again - go on until no determinant
falls; of the two results that with the smaller determinant counts. Its covariance is scaled to the median distance and
every variance has a floor, so that a statistic that is constant in clean text does not make every small deviation an
outlier.

A group's estimates are drawn to those of its language, and a language's to those of all rows, with the weight of
``DRAW`` rows: n rows count n to ``DRAW``, at every size alike, so a small group has no singular covariance and a large
one its own. A document whose squared Mahalanobis distance exceeds ``CUTOFF`` is rejected. That is chi-square's quantile
(five degrees of freedom) at 1 - 1.2e-11: of 10**10 clean documents with normal statistics less than one is lost, and
documents are judged by gross deviations only.

Only documents that pass the plain rules enter the estimates. All sums are of whole numbers, so results do not depend
on partitions; everything travels as partial sums, so a source with a third of the rows burdens no task.

Cases: null, empty and blank texts have no words and fail the plain rules; null languages and sources are groups of
their own; null ids stay null; an empty table gives no rows; repeated rows count each and are reported each; other
columns are ignored; windows of three words are compared by 64-bit hashes, whatever the length of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import Workspace

#: Share of the rows an estimate is from, rows that the wider estimate counts for, the least fall of the log determinant
#: that goes on, and the squared distance beyond which a document goes.
SHARE, DRAW, GAIN, CUTOFF = 0.75, 100.0, 1e-6, 60.0
#: The medians of chi-square with five degrees of freedom and of the absolute standard normal.
CHI_MEDIAN, NORMAL_MEDIAN = 4.351460191, 0.6744897502
SPACE = r"[\x20\x09-\x0D]+"
NAMES = ("x0", "x1", "x2", "x3", "x4")
P = len(NAMES)
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
VERDICT = f"NOT base_failed AND coalesce(d2, 0) <= {CUTOFF}"
#: Names of a row's language and of its source there; lengths and a mark for null keep them apart.
GROUPS = {"lang_name": "'l' || coalesce(length(lang) || ':' || lang, 'n')", "group_name": "'s' || coalesce(length(lang) || ':' || lang, 'n') || coalesce('=' || source, '~')"}
#: Transformed statistics, in thousandths: log length, log word length, log symbols and log repeated lines per hundred words, repeated share.
VECTOR = {
    "x0": "round(1000 * ln(1 + n_words))",
    "x1": "round(1000 * ln((1 + word_chars) / (1.0 + n_words)))",
    "x2": "round(1000 * ln(1 + 100.0 * n_symbols / (1 + n_words)))",
    "x3": "round(1000 * ln(1 + 100.0 * n_dup_lines / (1 + n_words)))",
    "x4": "round(1000.0 * n_repeat_words / (1 + n_words))",
}
#: Least standard deviation of each, in thousandths.
FLOORS = {"x0": 500, "x1": 80, "x2": 250, "x3": 250, "x4": 60}


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    kept = [c for c in docs.columns if c != text]
    out = docs.withColumn("_t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    out = out.select(
        *kept,
        F.length(F.regexp_replace("_t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        F.expr(r"transform(filter(split(_t, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]'), l -> xxhash64(l))").alias("_lines"),
        F.expr(r"transform(filter(split(_t, '[\\x20\\x09-\\x0D]+'), w -> w <> ''), w -> xxhash64(w))").alias("_h"),
    )
    out = out.select(
        *kept, "word_chars", "n_symbols", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), F.size("_h").cast("long").alias("n_words"),
        F.expr("CASE WHEN size(_h) >= 3 THEN transform(sequence(0, size(_h) - 3), i -> xxhash64(get(_h, i), get(_h, i + 1), get(_h, i + 2))) ELSE cast(array() AS array<bigint>) END").alias("_w"),
    )
    # sorting by hash, then place, brings equal windows together
    out = out.withColumn("_s", F.expr("CASE WHEN size(array_distinct(_w)) < size(_w) THEN sort_array(transform(_w, (h, i) -> struct(h, cast(i AS bigint) AS i))) ELSE cast(array() AS array<struct<h: bigint, i: bigint>>) END"))
    out = out.withColumn("_p", F.expr("sort_array(transform(filter(_s, (x, k) -> x.h <=> get(_s, k - 1).h OR x.h <=> get(_s, k + 1).h), x -> x.i))"))
    out = out.withColumn("n_repeat_words", F.expr("aggregate(_p, named_struct('last', -3L, 'n', 0L), (a, i) -> named_struct('last', i, 'n', a.n + least(3L, i - a.last)), a -> a.n)"))
    return out.select(*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words").alias("base_failed"))


def _estimates() -> str:
    """Location and floored covariance from the sums of the kept rows."""
    cells = [f"s{i} / n AS m{i}" for i in range(P)]
    for i in range(P):
        for j in range(i, P):
            cell = f"(s{i}{j} - s{i} * s{j} / n) / n"
            cells.append((f"greatest({cell}, {float(FLOORS[NAMES[i]] ** 2)})" if i == j else cell) + f" AS c{i}{j}")
    return ", ".join(cells)


def _moments(exact: str) -> str:
    """Sums of the kept rows; ``exact`` is the type that sums whole numbers without loss."""
    sums = [f"cast(sum(cast({a} AS {exact})) AS double) AS s{i}" for i, a in enumerate(NAMES)]
    sums += [f"cast(sum(cast({a} * {b} AS {exact})) AS double) AS s{i}{j}" for i, a in enumerate(NAMES) for j, b in enumerate(NAMES) if i <= j]
    return ", ".join(["cast(count(*) AS double) AS n", *sums])


def factored(source: str) -> str:
    """Adds the Cholesky factor l* of the covariance c* and its log determinant, as nested selects of both engines."""
    sql = source
    for i in range(P):
        for j in range(i + 1):
            inner = "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            cell = f"sqrt(greatest(c{j}{i}{inner}, 1e-3)) AS l{i}{i}" if i == j else f"(c{j}{i}{inner}) / l{j}{j} AS l{i}{j}"
            sql = f"(SELECT *, {cell} FROM {sql})"
    return f"(SELECT *, {' + '.join(f'ln(l{i}{i})' for i in range(P))} AS logdet FROM {sql})"


def distanced(source: str) -> str:
    """Adds d2, the squared Mahalanobis distance of x* from m* under the factor l*."""
    sql = source
    for i in range(P):
        sql = f"(SELECT *, (x{i} - m{i}" + "".join(f" - l{i}{k} * y{k}" for k in range(i)) + f") / l{i}{i} AS y{i} FROM {sql})"
    return f"(SELECT *, {' + '.join(f'y{i} * y{i}' for i in range(P))} AS d2 FROM {sql})"


CELLS = [f"m{i}" for i in range(P)] + [f"c{i}{j}" for i in range(P) for j in range(i, P)]
FACTOR = [f"m{i}" for i in range(P)] + [f"l{i}{j}" for i in range(P) for j in range(i + 1)]
#: A distance as a whole number that grows with it, so that percentiles are exact over few values.
KEY = "cast(round(1000 * ln(1 + {d2})) AS bigint)"
Step = list[tuple[str, str]]


def first_steps(percentile) -> Step:
    """From ``stats(lang_name, group_name, x*, base_failed)`` to ``near0(grp, st, x*, near)``, the distances of both starts.

    ``percentile``: (expression, share) -> SQL of the exact percentile of an engine.
    """
    xs = ", ".join(NAMES)
    return [
        ("pools", " UNION ALL ".join(f"SELECT {grp} AS grp, {xs} FROM stats WHERE NOT base_failed" for grp in ("group_name", "lang_name", "'all'"))),
        ("centres", f"SELECT grp, {', '.join(f'{percentile(x, 0.5)} AS m{i}' for i, x in enumerate(NAMES))} FROM pools GROUP BY grp"),
        ("spreads", f"SELECT p.grp, {', '.join(f'greatest({percentile(f"round(abs({x} - m{i}))", 0.5)} / {NORMAL_MEDIAN}, {float(FLOORS[x])}) AS w{i}' for i, x in enumerate(NAMES))} FROM pools p JOIN centres c ON p.grp = c.grp GROUP BY p.grp"),
        ("scaled", f"SELECT p.*, {', '.join(f'abs(x{i} - m{i}) / w{i} AS z{i}' for i in range(P))} FROM pools p JOIN centres c ON p.grp = c.grp JOIN spreads w ON p.grp = w.grp"),
        ("near0", f"SELECT grp, 0 AS st, {xs}, {KEY.format(d2=' + '.join(f'z{i} * z{i}' for i in range(P)))} AS near FROM scaled UNION ALL SELECT grp, 1 AS st, {xs}, {KEY.format(d2='greatest(' + ', '.join(f'z{i}' for i in range(P)) + ')')} AS near FROM scaled"),
    ]


def step(k: int, percentile, exact: str) -> Step:
    """Concentration step k: ``best{k}``, of the estimate before and that from the nearest rows the one of the smaller determinant."""
    cells = ", ".join(dict.fromkeys(("grp", "st", *CELLS, *FACTOR, "logdet")))
    fit = f"SELECT grp, st, {_estimates()} FROM (SELECT a.grp, a.st, {_moments(exact)} FROM near{k} a JOIN edge{k} e ON a.grp = e.grp AND a.st = e.st WHERE near <= edge GROUP BY a.grp, a.st)"
    steps = [("edge" + str(k), f"SELECT grp, st, {percentile('near', SHARE)} AS edge FROM near{k} GROUP BY grp, st"), ("fit" + str(k), f"SELECT {cells} FROM {factored(f'({fit})')}")]
    if k == 0:
        return [*steps, ("best0", "SELECT *, true AS moved FROM fit0")]
    chosen = ", ".join(f"CASE WHEN f.logdet < b.logdet - {GAIN} THEN f.{c} ELSE b.{c} END AS {c}" for c in cells.split(", ")[2:])
    return [*steps, (f"best{k}", f"SELECT b.grp, b.st, {chosen}, f.logdet < b.logdet - {GAIN} AS moved FROM best{k - 1} b JOIN fit{k} f ON b.grp = f.grp AND b.st = f.st")]


def distances(k: int) -> Step:
    """``near{k + 1}``: all rows by their distance under ``best{k}``."""
    own = f"(SELECT p.grp, b.st, {', '.join(f'p.{x}' for x in NAMES)}, {', '.join(f'b.{c}' for c in FACTOR)} FROM pools p JOIN best{k} b ON p.grp = b.grp)"
    return [(f"near{k + 1}", f"SELECT grp, st, {', '.join(NAMES)}, {KEY.format(d2='d2')} AS near FROM {distanced(own)}")]


def last_steps(k: int, percentile) -> Step:
    """From ``best{k}`` and ``near{k + 1}`` to ``verdict``: stats with d2 under the group's estimates, drawn to wider ones."""
    ahead = "b.logdet < a.logdet OR b.logdet = a.logdet AND b.st < a.st"
    scale = f"greatest((exp({percentile('near', 0.5)} / 1000.0) - 1) / {CHI_MEDIAN}, 1.0)"
    covariances = [c for c in CELLS if c[0] == "c"]
    mixed = lambda own, wide: ", ".join(f"(g.n * g.{c} + {DRAW} * w.{c}) / (g.n + {DRAW}) AS {c}" for c in CELLS)
    return [
        ("chosen", f"SELECT a.* FROM best{k} a WHERE NOT EXISTS (SELECT 1 FROM best{k} b WHERE a.grp = b.grp AND ({ahead}))"),
        ("scales", f"SELECT n.grp, {scale} AS factor, cast(count(*) AS double) AS n FROM near{k + 1} n JOIN chosen c ON n.grp = c.grp AND n.st = c.st GROUP BY n.grp"),
        ("mcd", f"SELECT c.grp, s.n, {', '.join(f'c.{c}' for c in CELLS if c[0] == 'm')}, {', '.join(f'factor * c.{c} AS {c}' for c in covariances)} FROM chosen c JOIN scales s ON c.grp = s.grp"),
        ("groups", "SELECT DISTINCT group_name, lang_name FROM stats WHERE NOT base_failed"),
        ("langs", f"SELECT g.grp, {mixed('g', 'w')} FROM mcd g CROSS JOIN (SELECT * FROM mcd WHERE grp = 'all') w WHERE g.grp LIKE 'l%'"),
        ("drawn", f"SELECT k.group_name, {mixed('g', 'w')} FROM groups k JOIN mcd g ON k.group_name = g.grp JOIN langs w ON k.lang_name = w.grp"),
        ("models", f"SELECT group_name AS model, {', '.join(FACTOR)} FROM {factored('drawn')}"),
        ("verdict", f"SELECT * FROM {distanced(f'(SELECT s.*, {', '.join(f'd.{c}' for c in FACTOR)} FROM stats s LEFT JOIN models d ON s.group_name = d.model)')}"),
    ]


def quality(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), one row for each document."""
    return judged(documents, id_col, text_col, lang_col, source_col).select("_row.*", *COLUMNS, F.expr(VERDICT).alias("kept"))


def judged(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """(_row, statistics.., d2): the id, or the columns ``keep``, of every row as a struct, and its squared distance."""
    spark = documents.sparkSession
    work = Workspace(spark, "quality")
    kept = [id_col] if keep is None else keep
    docs = documents.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").alias("_text"))
    stats = work.save(statistics(docs, "_text"), "texts").select("*", *(F.expr(f"cast({sql} AS bigint)").alias(x) for x, sql in VECTOR.items()), *(F.expr(sql).alias(x) for x, sql in GROUPS.items()))
    views = {"stats": stats}

    def run(steps: Step) -> None:
        for name, sql in steps:
            result = spark.sql(_with_views(sql, views), **{k: v for k, v in views.items() if _uses(sql, k)})
            views[name] = work.save(result, name) if name.rstrip("0123456789") in ("pools", "centres", "spreads", "near", "best", "mcd", "drawn") else result

    percentile, exact, k = (lambda x, share: f"percentile({x}, {share})"), "decimal(38, 0)", 0
    run(first_steps(percentile))
    run(step(0, percentile, exact))
    while True:  # each chain's determinant falls by a factor at every step it takes and has a floor, so this ends
        run(distances(k))
        work.drop(f"near{k}")
        run(step(k + 1, percentile, exact))
        k += 1
        if not views[f"best{k}"].filter("moved").take(1):
            break
    run([x for x in last_steps(k - 1, percentile)])
    work.drop("pools")
    return views["verdict"].select("_row", *COLUMNS, "d2")


def _uses(sql: str, name: str) -> bool:
    return f" {name} " in f"{sql} ".replace(")", " ").replace("\n", " ")


def _with_views(sql: str, views: dict[str, DataFrame]) -> str:
    """The SQL with its table names as parameters of spark.sql."""
    out = f"{sql} "
    for name in views:
        for word in ("FROM", "JOIN"):
            for end in (" ", ")", "\n"):
                out = out.replace(f"{word} {name}{end}", f"{word} {{{name}}}{end}")
    return out


def stats_sql() -> str:
    """DuckDB SQL of the statistics of ``documents``."""
    return r"""SELECT d.doc_id, d.lang, d.source, len(d.w)::BIGINT AS n_words, length(regexp_replace(d.t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(list_filter(string_split(d.t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(d.t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
        coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(d.w) < 50 OR 100 * coalesce(r.n_repeat_words, 0) > 50 * len(d.w) AS base_failed
    FROM (SELECT doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents) d
    LEFT JOIN (SELECT doc_id, sum(least(3, i - last)) AS n_repeat_words FROM (
        SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -3) AS last FROM (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (
                SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (
                    SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM (
                        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents))))
        WHERE n > 1) GROUP BY doc_id) r ON d.doc_id = r.doc_id"""


def oracle_ctes(steps: int = 12) -> str:
    """The DuckDB CTEs up to ``verdict``; concentration steps beyond the last that lowers a determinant change nothing."""
    percentile, exact = (lambda x, share: f"quantile_cont({x}, {share})"), "hugeint"
    out = [("texts", stats_sql()), ("stats", "SELECT *, " + ", ".join([f"cast({sql} AS bigint) AS {x}" for x, sql in VECTOR.items()] + [f"{sql} AS {x}" for x, sql in GROUPS.items()]) + " FROM texts")]
    out += [*first_steps(percentile), *step(0, percentile, exact)]
    for k in range(steps):
        out += [*distances(k), *step(k + 1, percentile, exact)]
    out += last_steps(steps - 1, percentile)
    return ",\n".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in out)


def oracle_sql() -> str:
    return f"""WITH {oracle_ctes()}
SELECT doc_id, {', '.join(COLUMNS)}, NOT base_failed AND coalesce(d2, 0) <= {CUTOFF} AS kept FROM verdict"""
