"""Incremental secret scanning over content-addressed versions.

Every version of every document is addressed by the SHA-256 of its text. A
ledger in the shared folder remembers which versions each path has had, which
(blob, rule, rule version) were scanned, and what was found. A run records its
versions, scans the pairs that the ledger lacks, once per blob however many
paths hold it, appends to the ledger, and joins all findings back to all paths
that have ever held the blob.

The ledger's tables are kept by generation. Runs append to the newest;
:func:`compact` writes the next one without repeats, in few files sorted by
blob, and drops the old. Findings and marks are partitioned by rule and
version, so a run reads those of its own rules only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..session import materialise, scratch_path

#: Up to this many unscanned blobs are broadcast (about 100 bytes each); beyond, texts that hold an anchor are moved to them.
BROADCAST_BLOBS = 20_000


@dataclass(frozen=True)
class Rule:
    """A pattern (group 0 is the secret) with a version to raise on every change; ``anchors``: literals of which a match holds one, in lower case if ``any_case``."""

    name: str
    version: int
    pattern: str
    anchors: tuple[str, ...]
    any_case: bool = False


_CREDENTIALS = ("api_key", "apikey", "passwd", "password", "secret", "token")
#: Either case spelt out: what (?i) folds differs from engine to engine.
_CREDENTIAL = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in _CREDENTIALS)
_VALUE = "[0-9A-Za-z_./+-]"
#: 16 characters or more with a digit among them, which names and calls in code seldom have; no engine but Java's looks ahead.
_BARE = "|".join([*(f"{_VALUE}{{{i}}}[0-9]{_VALUE}{{{15 - i},}}" for i in range(15)), f"{_VALUE}{{15,}}[0-9]{_VALUE}*"])
_KEY_END = "-----END [A-Z ]*PRIVATE KEY-----"
#: Through the END line; without one, headers and all up to the last long run of base64 and a padded end.
_KEY_BODY = rf"[^-]*(?:-{{1,4}}[^-]+){{0,32}}{_KEY_END}|(?:[ \t\r\n]+[A-Za-z-]+:[^\n]*){{0,8}}[0-9A-Za-z+/= \t\r\n\\]*[0-9A-Za-z+/=]{{20}}(?:[ \t\r\n]+[0-9A-Za-z+/]*={{1,2}})?"

RULES = (
    Rule("aws_access_key", 1, r"(?:AKIA|ASIA)[0-9A-Z]{16}", ("AKIA", "ASIA")),
    Rule("github_token", 1, r"gh[pousr]_[0-9A-Za-z]{36}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("google_api_key", 1, r"AIza[0-9A-Za-z_-]{35}", ("AIza",)),
    Rule("json_web_token", 1, r"eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}", ("eyJ",)),
    Rule("private_key", 2, rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_KEY_BODY})?", ("PRIVATE KEY-----",)),
    Rule("quoted_credential", 3, rf"""(?:{_CREDENTIAL})["']?[ \t]*[:=][ \t]*(?:["']{_VALUE}{{16,}}={{0,2}}["']|(?:{_BARE})={{0,2}})""", _CREDENTIALS, True),
    Rule("slack_token", 1, r"xox[abprs]-[0-9A-Za-z-]{10,}", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("url_password", 1, r"""[a-z]+://[^/ \t\n:@"']{1,64}:[^/ \t\n:@"']{1,64}@[0-9A-Za-z.-]+""", ("://",)),
)

_SCANNED = "blob binary, rule string, version int"
_FOUND = "blob binary, fingerprint string, n bigint, rule string, version int"
_TABLES = ("paths", "scanned", "findings")
_BY_RULE = ("rule", "version")


def _generation(spark: SparkSession, ledger: str, table: str) -> int:
    """The newest generation that was written to its end; 0 at first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/{table}")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return 0
    names = [x.getPath().getName() for x in files.listStatus(folder) if x.isDirectory()]
    done = [int(n[1:]) for n in names if n[:1] == "g" and n[1:].isdigit() and (n == "g0" or files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/{table}/{n}/_SUCCESS")))]
    return max(done, default=0)


def _current_path(spark: SparkSession, ledger: str, table: str) -> str:
    return f"{ledger}/{table}/g{_generation(spark, ledger, table)}"


def _read(spark: SparkSession, ledger: str, table: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(_current_path(spark, ledger, table))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _append(rows: DataFrame, ledger: str, table: str) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(*_BY_RULE) if table != "paths" else writer).parquet(_current_path(rows.sparkSession, ledger, table))


def compact(spark: SparkSession, ledger: str, files: int = 16) -> None:
    """Rewrite each table of the ledger without repeated rows in about ``files`` files, as its next generation; no run may append meanwhile."""
    for table in _TABLES:
        now = _generation(spark, ledger, table)
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/{table}/g{now}")
        system = old.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(old):
            continue
        rows = spark.read.parquet(f"{ledger}/{table}/g{now}").distinct()
        by = ["blob"] if table == "paths" else [*_BY_RULE, "blob"]
        writer = rows.repartitionByRange(files, *by).sortWithinPartitions(*by).write.mode("overwrite")
        (writer.partitionBy(*_BY_RULE) if table != "paths" else writer).parquet(f"{ledger}/{table}/g{now + 1}")
        system.delete(old, True)


def _blob(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _anchored(text: Column, rule: Rule) -> Column:
    there = F.lit(False)
    text = F.lower(text) if rule.any_case else text
    for a in rule.anchors:
        there = there | F.contains(text, F.lit(a))
    return there


def _hits(rule: Rule) -> Column:
    """The matches of one rule in ``text``, if it is among ``todo``, as structs."""
    matches = F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))
    wanted = F.when(F.array_contains("todo", rule.name) & _anchored(F.col("text"), rule), matches).otherwise(F.array().cast("array<string>"))
    return F.transform(wanted, lambda s: F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.version).alias("version"), s.alias("secret")))


def _current(table: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    same = F.lit(False)
    for r in rules:
        same = same | ((F.col("rule") == r.name) & (F.col("version") == r.version))
    return table.where(same)


def update(texts: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Record the versions in ``texts`` (columns path, text; null texts are no versions) and scan what ``ledger`` lacks of them.

    Findings are written before the marks that they are complete: a run that
    dies between the two is repeated, and reading the ledger drops repeats. A
    text without any anchor of a rule has nothing to find, so of the unscanned
    blobs only those with an anchor are matched, each once.
    """
    spark = texts.sparkSession
    kind = texts.schema["path"].dataType.simpleString()
    here = texts.where(F.col("text").isNotNull()).select("path", "text", _blob(F.col("text")).alias("blob"))
    paths = materialise(here.select("path", "blob").distinct(), "paths")
    known = _read(spark, ledger, "paths", f"path {kind}, blob binary").select(F.col("path").alias("k_path"), F.col("blob").alias("k_blob"))
    _append(paths.join(known, (F.col("blob") == F.col("k_blob")) & F.col("path").eqNullSafe(F.col("k_path")), "left_anti"), ledger, "paths")
    done = _current(_read(spark, ledger, "scanned", _SCANNED), rules).groupBy("blob").agg(F.collect_set("rule").alias("done"))
    names = F.array(*[F.lit(r.name) for r in rules])
    left = F.array_except(names, F.coalesce("done", F.array().cast("array<string>")))
    todo = paths.select("blob").distinct().join(done, "blob", "left").select("blob", left.alias("todo")).where(F.size("todo") > 0)
    todo = materialise(todo, "unscanned")
    n = todo.count()
    if not n:
        return
    anchored = F.lit(False)
    for r in rules:
        anchored = anchored | _anchored(F.col("text"), r)
    if n <= BROADCAST_BLOBS:
        held = here.select("blob", "text").join(F.broadcast(todo), "blob").where(anchored).dropDuplicates(["blob"])
    else:
        held = here.where(anchored).select("blob", "text").dropDuplicates(["blob"]).join(todo.hint("shuffle_hash"), "blob")
    each = held.select("blob", F.explode(F.concat(*[_hits(r) for r in rules])).alias("x")).select("blob", "x.*")
    found = each.groupBy("blob", F.sha2("secret", 256).substr(1, 16).alias("fingerprint"), *_BY_RULE).agg(F.count(F.lit(1)).alias("n"))
    _append(found.select("blob", "fingerprint", "n", *_BY_RULE), ledger, "findings")
    versions = F.create_map(*[x for r in rules for x in (F.lit(r.name), F.lit(r.version))])
    _append(todo.select("blob", F.explode("todo").alias("rule")).select("blob", "rule", versions[F.col("rule")].alias("version")), ledger, "scanned")


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    return _current(_read(spark, ledger, "findings", _FOUND), rules).distinct()


def scan(docs: DataFrame, ledger: str | None = None, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per path, version, rule and distinct secret: ``doc_id``, ``blob`` (hex), ``rule``, ``fingerprint`` (of the secret), ``n`` occurrences.

    All versions that ``ledger`` has recorded count, so a secret that a path
    held once is reported for it ever after. Without ``ledger`` a new one is
    made in the shared folder. A null text has no blob and no findings; '' has
    a blob without findings. Texts are scanned whole. Paths that share a text
    get the same findings; a row repeated in the table is one path and appears
    once; a null id is a path of its own. Extra columns are not read, whatever
    their names; an empty table adds nothing.
    """
    spark = docs.sparkSession
    ledger = ledger or scratch_path(spark, "ledger")
    update(docs.select(F.col(doc_id).alias("path"), F.col(text).alias("text")), ledger, rules)
    paths = _read(spark, ledger, "paths", f"path {docs.schema[doc_id].dataType.simpleString()}, blob binary").distinct()
    joined = paths.join(findings(spark, ledger, rules), "blob")
    return joined.select(F.col("path").alias(doc_id), F.lower(F.hex("blob")).alias("blob"), "rule", "fingerprint", "n")


def scan_history(docs: DataFrame, parts: int = 2, ledger: str | None = None, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """:func:`scan` of a table that arrives in ``parts`` runs over one ledger: rows are dealt by a hash of their id, and each run scans only what is new."""
    ledger = ledger or scratch_path(docs.sparkSession, "ledger")
    dealt = F.pmod(F.xxhash64(doc_id), F.lit(parts))
    for i in range(parts - 1):
        update(docs.where(dealt == i).select(F.col(doc_id).alias("path"), F.col(text).alias("text")), ledger, rules)
    return scan(docs.where(dealt == parts - 1), ledger, doc_id, text, rules)


def redact(docs: DataFrame, ledger: str | None = None, doc_id: str = "doc_id", text: str = "text", length: str = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every secret found replaced by ``[rule]`` and ``length``, where present, made to fit; no row goes.

    The ledger decides which rules a text is rewritten by, so clean texts are
    left as they are. Null texts stay null, '' stays ''; very long texts are
    rewritten whole; repeated rows and null ids are rewritten like others; all
    other columns stay as they are, whatever their names. An empty table gives
    an empty result.
    """
    spark = docs.sparkSession
    ledger = ledger or scratch_path(spark, "ledger")
    update(docs.select(F.col(doc_id).alias("path"), F.col(text).alias("text")), ledger, rules)
    hit = materialise(findings(spark, ledger, rules).groupBy("blob").agg(F.collect_set("rule").alias("found")), "secret-blobs")
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), _blob(F.col(text)).alias("blob"))
    joined = rows.join(hit.withColumnRenamed("blob", "h_blob"), F.col("blob") == F.col("h_blob"), "left")
    clean = F.col("text")
    for r in rules:
        # a pattern that matches nothing keeps this a chain, where a branch per rule would double it each time
        pattern = F.when(F.array_contains("found", r.name), F.lit(r.pattern)).otherwise(F.lit("(?!)"))
        clean = F.regexp_replace(clean, pattern, F.lit(f"[{r.name}]"))
    dirty = F.col("found").isNotNull()
    safe = joined.select("row", "found", F.when(dirty, clean).alias("clean"))
    kind = dict(docs.dtypes)
    changed = {text: F.when(dirty, F.col("clean")).otherwise(F.col("row")[text])}
    if length in kind and length != text:
        changed[length] = F.when(dirty, F.char_length("clean").cast(kind[length])).otherwise(F.col("row")[length])
    return safe.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def scan_sql(table: str = "documents", rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for the rows of :func:`scan`."""
    quoted = lambda s: s.replace("'", "''")
    each = " UNION ALL ".join(f"SELECT doc_id, text, '{r.name}' AS rule, unnest(regexp_extract_all(text, '{quoted(r.pattern)}')) AS secret FROM p" for r in rules)
    return f"""WITH p AS (SELECT DISTINCT doc_id, text FROM {table} WHERE text IS NOT NULL)
SELECT doc_id, sha256(text) AS blob, rule, substr(sha256(secret), 1, 16) AS fingerprint, count(*) AS n
FROM ({each}) GROUP BY ALL"""
