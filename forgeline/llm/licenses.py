"""Licence scan by sparse TF-IDF cosine to templates, and inheritance along directories (operator 6).

Everything is DataFrame or SQL expressions.
"""

from __future__ import annotations

from importlib.resources import files as resources

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from forgeline.sources.tables import settle

# Identifiers and the wording of common notices.
TEMPLATES = (
    ("AGPL-3.0", "licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("LGPL-2.1", "licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "subject to the terms of the Mozilla Public License, version 2.0"),
    ("Proprietary", "All rights reserved"),
    ("Proprietary", "All rights reserved. No part may be reproduced without permission"),
)
# Words without weight in templates; fixed values.
STOP_WORDS = (
    "a all and any are be by in is may no of on or part the this to under use with without".split()
)
LEAST_COSINE = 0.75  # of a header line to its template, and of a whole text to a licence's
LEAST_TERMS = 2  # of a template's words that a header has; one rare word isn't a notice
RESERVED = "Proprietary"  # notices that open licences carry too, so any other licence of a file goes first
FILE_SHARE = 0.25  # share of template words from which a text of little more than a notice is a licence file
WRAPPED = 4  # adjacent lines that a wrapped notice may take
NOT_WORD = "[^a-z0-9]+"


def template_terms(spark: SparkSession) -> DataFrame:
    """(template, license, term, tf); a few hundred rows, fixed."""
    values = ", ".join(f"({k}, '{spdx}', '{text}')" for k, (spdx, text) in enumerate(TEMPLATES))
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t(template, license, body)")
    terms = table.select("template", "license", F.explode(F.split(F.lower("body"), NOT_WORD)).alias("term"))
    usual = terms.filter((F.col("term") != "") & ~F.col("term").isin(*STOP_WORDS))
    return usual.groupBy("template", "license", "term").agg(F.count("*").alias("tf"))


def whole_texts() -> list[tuple[str, str]]:
    """(license, text) of the licences known in full, by name."""
    found = [p for p in resources(__package__).joinpath("license_texts").iterdir() if p.name.endswith(".txt")]
    return sorted((p.name.removesuffix(".txt"), p.read_text("utf-8")) for p in found)


def _damped(tf: str):
    return F.log(F.col(tf)) + 1.0


def whole_terms(spark: SparkSession) -> DataFrame:
    """(license, term, idf, tw) over all words of the licences' whole texts; some 10,000 rows, fixed.

    Counts are damped and weighted by the inverse frequency among the licences, so a verdict
    depends on the text alone and not on the other files.
    """
    texts = F.explode(F.array(*[F.struct(F.lit(a).alias("license"), F.lit(b).alias("body")) for a, b in whole_texts()]))
    words = spark.range(1).select(texts.alias("t")).select("t.license", F.explode(F.split(F.lower("t.body"), NOT_WORD)).alias("term"))
    counts = settle(words.filter("term != ''").groupBy("license", "term").agg(F.count("*").alias("tf")), "licence-texts")
    usual = F.count("*").over(Window.partitionBy("term"))
    known = F.lit(1.0 + len(whole_texts()))
    weighted = counts.withColumn("idf", F.log(known / (usual + 1.0)) + 1.0).withColumn("w", _damped("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("license")))
    return settle(weighted.select("license", "term", "idf", (F.col("w") / length).alias("tw")), "licence-weights")


def whole_matches(rows: DataFrame, text: str) -> DataFrame:
    """(uid, w_license, w_cosine) of the texts that as a whole are one of the licences.

    All words of a text count, those of no licence as if one licence had them. A cosine can't
    exceed the root of the squared weight of those words of the licence that the text has;
    only texts that pass by this bound get their words counted.
    """
    full = whole_terms(rows.sparkSession)
    names = [name for name, _ in whole_texts()]
    parts = [f"c{k}" for k in range(len(names))]
    shares = full.groupBy("term").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("license") == name, F.col("tw") * F.col("tw"))), F.lit(0.0)).alias(c)
            for name, c in zip(names, parts)
        ]
    )
    split = F.split(F.lower(text), NOT_WORD)
    distinct = rows.select("uid", F.explode(F.array_distinct(split)).alias("term"))
    bound = distinct.join(F.broadcast(shares), "term").groupBy("uid").agg(*[F.sum(c).alias(c) for c in parts])
    near = settle(
        bound.filter(F.greatest(*parts) >= LEAST_COSINE * LEAST_COSINE - 1e-6).select("uid"), "licence-candidates"
    )
    words = rows.join(near, "uid", "left_semi").select("uid", F.explode(split).alias("term")).filter("term != ''")
    counts = words.groupBy("uid", "term").agg(F.count("*").alias("tf"))
    idf = F.broadcast(full.groupBy("term").agg(F.first("idf").alias("idf")))
    rare = F.log(F.lit((1.0 + len(names)) / 2.0)) + 1.0
    weighted = settle(
        counts.join(idf, "term", "left").select("uid", "term", (_damped("tf") * F.coalesce("idf", rare)).alias("w")),
        "licence-words",
    )
    norms = weighted.groupBy("uid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    cosines = (
        weighted.join(F.broadcast(full), "term")
        .groupBy("uid", "license")
        .agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
        .join(norms, "uid")
        .select("uid", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"))
        .filter(F.col("cosine") >= LEAST_COSINE)
    )
    best = cosines.groupBy("uid").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("at"))
    return best.select("uid", F.col("at.license").alias("w_license"), (-F.col("at.less")).alias("w_cosine"))


def _parents(path: str):
    """Directories above a path, the nearest first; the root is the empty string."""
    steps = F.split(path, "/")
    return F.transform(
        F.sequence(F.size(steps) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/")
    )


def _first(name: str):
    """Of a whole licence, a short licence file, a wrapped notice and a line, what counts."""
    return (
        F.when(F.col("w_license").isNotNull(), F.col(f"w_{name}"))
        .when(F.col("short"), F.col(f"f_{name}"))
        .when(F.col("over"), F.col(f"n_{name}"))
        .otherwise(F.col(f"h_{name}"))
    )


def _cosines(hits: DataFrame, idf: DataFrame, templates: DataFrame) -> DataFrame:
    """(uid, line, hits, license, cosine) of passages, given by their terms, that are near a template."""
    passages = hits.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norms = passages.groupBy("uid", "line").agg(
        F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("hits")
    )
    return (
        passages.join(templates, "term")
        .groupBy("uid", "line", "template", "license")
        .agg(F.sum(F.col("w") * F.col("tw")).alias("dot"), F.count("*").alias("shared"))
        .filter(F.col("shared") >= LEAST_TERMS)
        .join(norms, ["uid", "line"])
        .select("uid", "line", "hits", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"))
        .filter(F.col("cosine") >= LEAST_COSINE)
    )


def _wrapped(hits: DataFrame, idf: DataFrame, templates: DataFrame, headed: DataFrame, order: list) -> DataFrame:
    """(uid, n_license, n_cosine) of notices over 2 to ``WRAPPED`` adjacent lines, in files not ``headed`` by a line.

    Only files that have enough of a template's weight in all their lines get windows.
    """
    near = (
        hits.select("uid", "term")
        .distinct()
        .join(templates, "term")
        .groupBy("uid", "template")
        .agg(F.sum(F.col("tw") * F.col("tw")).alias("most"))
        .filter(F.col("most") >= LEAST_COSINE * LEAST_COSINE - 1e-6)
    )
    open_ = settle(
        hits.join(near.select("uid").distinct(), "uid", "left_semi").join(headed, "uid", "left_anti"), "licence-open"
    )
    windows = F.array(
        *[
            F.struct(F.lit(width).alias("width"), (F.col("line") - back).alias("start"))
            for width in range(2, WRAPPED + 1)
            for back in range(width)
        ]
    )
    lines = (
        open_.select("uid", "term", "tf", F.explode(windows).alias("at"))
        .filter("at.start >= 0")
        .groupBy("uid", F.col("at").alias("line"), "term")
        .agg(F.sum("tf").alias("tf"))
    )
    best = _cosines(lines, idf, templates).withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(*order)))
    return best.filter("rank = 1").select("uid", F.col("license").alias("n_license"), F.col("cosine").alias("n_cosine"))


def scan(files: DataFrame, key: str = "doc_id", path: str = "path", text: str = "text") -> DataFrame:
    """Licence of every file: from its own lines, or from the nearest directory above that has a licence file.

    Lines and whole texts become term vectors over the templates' words, weighted by inverse
    document frequency over all files. A line whose cosine to a template is ``LEAST_COSINE`` or
    more is a licence header of the file. A text that as a whole is as near to a template, and of
    whose words ``FILE_SHARE`` are template words, makes its directory's licence. ``origin``
    says ``header``, ``file``, ``inherited`` or null.

    The templates' words, a fixed small table, are broadcast; only texts' hits on them are
    shuffled. Inheritance is settled once per directory, then joined to its files. Of several
    licences of a file the one with the higher cosine counts, then the first by name; reserved
    rights count only where there is no other, as licensed files state them too. Null or empty texts have no licence of their
    own. A null path has no directory and inherits nothing. Null keys and repeated rows are
    rows like others. An empty table gives no rows. Other columns are not read. The table is
    scanned four times and rows are told apart by their place in it, so it should be a stored one.
    """
    spark = files.sparkSession
    terms = template_terms(spark)
    vocabulary = F.broadcast(terms.select("term").distinct())
    rows = files.select(F.monotonically_increasing_id().alias("uid"), key, path, text)
    lines = rows.select("uid", F.posexplode(F.split(F.lower(text), "\n")).alias("line", "body"))
    words = lines.select("uid", "line", F.explode(F.split("body", NOT_WORD)).alias("term"))
    hits = settle(
        words.join(vocabulary, "term").groupBy("uid", "line", "term").agg(F.count("*").alias("tf")), "licence-hits"
    )
    listed = settle(
        rows.select(
            "uid", key, path, F.size(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")).alias("words")
        ),
        "licence-files",
    )
    total = F.lit(1.0 + listed.count())
    frequency = hits.select("uid", "term").distinct().groupBy("term").agg(F.count("*").alias("df"))
    idf = (
        terms.select("term")
        .distinct()
        .join(frequency, "term", "left")
        .select("term", (F.log(total / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0).alias("idf"))
    )
    weighted = terms.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = Window.partitionBy("template")
    templates = F.broadcast(
        weighted.select(
            "template", "license", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(length))).alias("tw")
        )
    )
    whole = hits.groupBy("uid", "term").agg(F.sum("tf").alias("tf")).select("uid", F.lit(-1).alias("line"), "term", "tf")
    order = [F.col("license") == RESERVED, F.col("cosine").desc(), F.col("license")]
    cosines = _cosines(hits.unionByName(whole), idf, templates)
    ranked = cosines.withColumn("own", F.col("line") >= 0).withColumn(
        "rank", F.row_number().over(Window.partitionBy("uid", "own").orderBy(*order))
    )
    ranked = settle(ranked.filter("rank = 1"), "licence-ranked")
    header = ranked.filter("own").select("uid", F.col("license").alias("h_license"), F.col("cosine").alias("h_cosine"))
    wrapped = _wrapped(hits, idf, templates, header.filter(F.col("h_license") != RESERVED), order)
    file = ranked.filter("not own").select(
        "uid", F.col("license").alias("f_license"), F.col("cosine").alias("f_cosine"), "hits"
    )
    found = settle(
        listed.join(header, "uid", "left")
        .join(wrapped, "uid", "left")
        .join(file, "uid", "left")
        .join(whole_matches(rows, text), "uid", "left")
        .withColumn("short", F.coalesce(F.col("hits") >= FILE_SHARE * F.col("words"), F.lit(False)))
        # a wrapped notice goes before reserved rights on a line, or else after
        .withColumn("over", F.coalesce(F.col("n_license") != RESERVED, F.lit(False)) | F.col("h_license").isNull())
        .withColumn("directory", F.when(F.col(path).isNotNull(), F.get(_parents(path), F.lit(0))))
        .select(
            key,
            path,
            "directory",
            _first("license").alias("license"),
            _first("cosine").alias("cosine"),
            F.when(F.col("w_license").isNotNull() | F.col("short"), "file")
            .when(F.coalesce("n_license", "h_license").isNotNull(), "header")
            .alias("origin"),
        ),
        "licence-found",
    )
    # a minimum over structs combines before the shuffle, however many files a directory has
    granted = (
        found.filter((F.col("origin") == "file") & F.col("directory").isNotNull())
        .groupBy(F.col("directory").alias("granting"))
        .agg(F.min(F.struct(-F.col("cosine"), "license"))["license"].alias("granted"))
    )
    directories = found.filter(F.col("license").isNull() & F.col("directory").isNotNull()).select("directory").distinct()
    above = directories.select(
        "directory", F.posexplode(F.concat(F.array("directory"), _parents("directory"))).alias("steps", "granting")
    )
    nearest = (
        above.join(granted, "granting")
        .groupBy("directory")
        .agg(F.min(F.struct("steps", "granting", "granted")).alias("at"))
        .select(F.col("directory").alias("below"), "at.granting", "at.granted")
    )
    inherits = F.col("license").isNull() & F.col("granted").isNotNull()
    return found.join(nearest, (F.col("directory") == F.col("below")) & F.col("license").isNull(), "left").select(
        key,
        path,
        F.coalesce("license", "granted").alias("license"),
        F.when(inherits, "inherited").otherwise(F.col("origin")).alias("origin"),
        "cosine",
        F.when(inherits, F.col("granting")).alias("inherited_from"),
    )


def oracle_sql() -> str:
    """The same scan of ``documents`` for DuckDB."""
    quoted = ", ".join(f"({k}, '{spdx}', '{text}')" for k, (spdx, text) in enumerate(TEMPLATES))
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    split = f"string_split_regex(%s, '{NOT_WORD}')"
    return f"""
WITH templates(template, license, body) AS (VALUES {quoted}),
terms AS MATERIALIZED (
    SELECT template, license, term, count(*) AS tf
    FROM (SELECT template, license, unnest({split % 'lower(body)'}) AS term FROM templates)
    WHERE term <> '' AND term NOT IN ({stop}) GROUP BY ALL
), listed AS MATERIALIZED (
    SELECT row_number() OVER () AS uid, doc_id, concat_ws('/', source, lang, doc_id) AS path,
           lower(coalesce(text, '')) AS body
    FROM documents
), lines AS (
    SELECT uid, generate_subscripts(parts, 1) AS line, unnest(parts) AS body
    FROM (SELECT uid, string_split(body, chr(10)) AS parts FROM listed)
), hits AS MATERIALIZED (
    SELECT uid, line, term, count(*) AS tf
    FROM (SELECT uid, line, unnest({split % 'body'}) AS term FROM lines)
    WHERE term IN (SELECT term FROM terms) GROUP BY ALL
), idf AS (
    SELECT t.term, ln((1.0 + (SELECT count(*) FROM listed)) / (1.0 + coalesce(df, 0))) + 1.0 AS idf
    FROM (SELECT DISTINCT term FROM terms) t
    LEFT JOIN (SELECT term, count(DISTINCT uid) AS df FROM hits GROUP BY term) USING (term)
), weighted AS (
    SELECT template, license, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY template)) AS tw
    FROM terms JOIN idf USING (term)
), passages AS (
    SELECT uid, line, term, tf, tf * idf AS w
    FROM (SELECT * FROM hits UNION ALL SELECT uid, -1, term, sum(tf) FROM hits GROUP BY uid, term) JOIN idf USING (term)
), norms AS (
    SELECT uid, line, sqrt(sum(w * w)) AS norm, sum(tf) AS hits FROM passages GROUP BY ALL
), cosines AS (
    SELECT uid, line, license, any_value(hits) AS hits, round(sum(w * tw) / any_value(norm), 6) AS cosine
    FROM passages JOIN weighted USING (term) JOIN norms USING (uid, line) GROUP BY uid, line, template, license
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY uid, line > 0 ORDER BY cosine DESC, license) AS rank
    FROM cosines WHERE cosine >= {LEAST_COSINE}
), found AS (
    SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS directory,
           coalesce(f.hits >= {FILE_SHARE} * len(list_filter({split % 'body'}, lambda x: x <> '')), false) AS is_file,
           f.license AS f_license, f.cosine AS f_cosine, h.license AS h_license, h.cosine AS h_cosine
    FROM listed
    LEFT JOIN (SELECT * FROM ranked WHERE rank = 1 AND line > 0) h USING (uid)
    LEFT JOIN (SELECT * FROM ranked WHERE rank = 1 AND line < 0) f USING (uid)
), own AS MATERIALIZED (
    SELECT doc_id, path, directory, CASE WHEN is_file THEN f_license ELSE h_license END AS license,
           CASE WHEN is_file THEN f_cosine ELSE h_cosine END AS cosine,
           CASE WHEN is_file THEN 'file' WHEN h_license IS NOT NULL THEN 'header' END AS origin
    FROM found
), granted AS (
    SELECT directory, license FROM own WHERE origin = 'file'
    QUALIFY row_number() OVER (PARTITION BY directory ORDER BY cosine DESC, license) = 1
), below AS (
    SELECT d.directory, g.directory AS granting, g.license AS granted
    FROM (SELECT DISTINCT directory FROM own) d
    JOIN granted g ON g.directory = d.directory OR starts_with(d.directory, g.directory || '/') OR g.directory = ''
    QUALIFY row_number() OVER (PARTITION BY d.directory ORDER BY length(g.directory) DESC) = 1
)
SELECT doc_id, path, coalesce(license, granted) AS license,
       CASE WHEN license IS NULL AND granted IS NOT NULL THEN 'inherited' ELSE origin END AS origin, cosine,
       CASE WHEN license IS NULL AND granted IS NOT NULL THEN granting END AS inherited_from
FROM own LEFT JOIN below USING (directory)
"""
