"""Secret scan with a random forest that removes false positives.

Candidates are values after a telling name (`token = "..."`) and long tokens that hold a digit. For each, SQL functions
compute its length, shares of character classes, transitions (changes of class, common pairs of letters, steps of the alphabet
and of counting), coverage by dictionary words and the longest word, the document's path and the neighbouring words. A random forest, trained on labelled findings when the operator runs, keeps the true ones.
Texts are scanned where they are read; nothing is shuffled, so hot sources and repeated texts cost no more than others.

Null and empty texts have no candidates. Repeated rows give repeated findings. Very long texts are scanned whole. Of two
candidates that begin at one place the named one counts; a probability of exactly the threshold is no secret. An empty table
gives no rows. Columns other than doc_id, text and the path column are ignored; a table may lack the path column.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

NAMES = r"(?i:pass(?:word|wd|phrase)|pwd|secret|token|api[_\-]?key|access[_\-]?key|private[_\-]?key|auth|credential)"
BODY = r"A-Za-z0-9_+/\-"
ASSIGNED = NAMES + r"(?i:[_\-]?(?:key|token|value))?[\"']?[ \t]{0,4}(?::=|[=:])[ \t]{0,4}[\"']?"
CANDIDATE = (
    ASSIGNED + r"[^\s\"']{6,}"
    rf"|(?<![{BODY}])(?=[A-Za-z_+/\-]*+[0-9])[{BODY}]{{16,}}={{0,2}}"
)
PREFIXED = r"^(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|rk_live_|AIza|eyJ|glpat-|npm_)"
#: Parts of ordinary words and names, longest first where one holds another.
DICTIONARY = (
    "authentication|configuration|application|description|environment|information|placeholder|development|production|"
    "password|username|document|function|resource|internal|external|response|template|changeme|question|example|version|"
    "service|request|account|default|setting|message|package|project|section|address|number|string|object|public|client|"
    "server|sample|secret|access|update|module|simple|return|system|folder|import|master|branch|dummy|value|token|admin|"
    "class|index|table|field|model|image|store|group|login|where|their|which|about|other|would|there|these|could|tion|"
    "with|that|this|from|have|your|here|user|file|page|name|data|test|path|list|type|code|item|view|read|main|home|"
    "http|www|key|the|and|for|not|you|are|get|set|log|app|api|url|ing|com|org|net"
)
#: Characters before and after a candidate that count as its neighbours.
NEAR = 48
FEATURES = [
    "f_length", "f_digits", "f_upper", "f_lower", "f_marks", "f_changes", "f_words", "f_distinct", "f_hex", "f_uuid",
    "f_prefixed", "f_placeholder", "f_assigned", "f_named", "f_digest", "f_quoted", "f_path", "f_pairs", "f_steps", "f_longest", "f_code", "f_number",
]
#: Common pairs of letters, steps of the alphabet and of counting, and what is code or a reference rather than a value.
PAIRS = "(?=" + "|".join("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de ri ro ic ne ea ra ce li ch ll be ma si om ur ge ol ac ct ta".split()) + ")"
STEPS = "(?=" + "|".join(s[i : i + 3] for s in ("abcdefghijklmnopqrstuvwxyz", "0123456789") for i in range(len(s) - 2)) + ")"
CODE = r"\$[{(]|\(\)|\w\(|^[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+$|^[./]|\["
THRESHOLD = 0.5


def candidates(documents: DataFrame, path: str | None = "source") -> DataFrame:
    """doc_id, ord, start (characters before the value), name, value, before, after, path."""
    text = F.coalesce(F.col("text"), F.lit(""))
    where = F.col(f"`{path}`").cast("string") if path and path.lower() in {c.lower() for c in documents.columns} else F.lit(None).cast("string")
    cut = documents.select("doc_id", where.alias("path"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("found"), F.split(text, CANDIDATE, -1).alias("parts"))
    cut = cut.where(F.size("found") > 0)
    # where each match starts: lengths of all parts and matches before it
    lengths = F.zip_with("found", F.slice("parts", 1, F.size("found")), lambda m, p: F.struct(F.length(p).alias("p"), F.length(m).alias("m")))
    starts = F.aggregate(
        lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda a, x: F.struct((a["at"] + x["p"] + x["m"]).alias("at"), F.concat(a["out"], F.array(a["at"] + x["p"])).alias("out")),
        lambda a: a["out"],
    )
    rows = cut.select(
        "doc_id", "path",
        F.posexplode(F.zip_with(F.arrays_zip(F.col("found").alias("m"), F.slice("parts", 1, F.size("found")).alias("b")), F.arrays_zip(F.slice("parts", 2, F.size("found")).alias("a"), starts.alias("s")), lambda x, y: F.struct(x["m"].alias("m"), F.substring(x["b"], -NEAR, NEAR).alias("b"), F.substring(y["a"], 1, NEAR).alias("a"), y["s"].alias("s")))).alias("ord", "x"),
    )
    name = F.regexp_extract("x.m", "^" + ASSIGNED, 0)
    return rows.select(
        "doc_id", "ord", (F.col("x.s") + F.length(name)).alias("start"), name.alias("name"),
        F.substring("x.m", F.length(name) + 1, F.length("x.m")).alias("value"),
        F.col("x.b").alias("before"), F.col("x.a").alias("after"), "path",
    )


def featured(found: DataFrame) -> DataFrame:
    """found with the columns of FEATURES."""
    value, low, n = F.col("value"), F.lower("value"), F.greatest(F.length("value"), F.lit(1))
    near = F.concat_ws(" ", F.lower("before"), F.lower("name"))

    def share(pattern: str) -> Column:
        return F.regexp_count(value, F.lit(pattern)) / n

    def flag(test: Column) -> Column:
        return F.coalesce(test, F.lit(False)).cast("double")

    return found.withColumns(
        {
            "f_length": F.least(n, F.lit(200)).cast("double"),
            "f_digits": share("[0-9]"), "f_upper": share("[A-Z]"), "f_lower": share("[a-z]"), "f_marks": share("[^A-Za-z0-9]"),
            "f_changes": share("[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[^A-Za-z0-9](?=[A-Za-z0-9])"),
            "f_words": 1 - F.length(F.regexp_replace(low, DICTIONARY, "")) / n,
            "f_distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64)),
            "f_hex": flag(low.rlike("^[0-9a-f]+$")),
            "f_uuid": flag(low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
            "f_prefixed": flag(value.rlike(PREFIXED)),
            "f_placeholder": flag(low.rlike(r"example|sample|changeme|placeholder|dummy|your|xxxx|test|\*\*\*|<|\{|\$\(|1234")),
            "f_assigned": flag(F.length("name") > 0),
            "f_named": flag(near.rlike(r"pass|secret|token|key|auth|credential|bearer")),
            "f_digest": flag(F.concat_ws(" ", near, F.lower("after")).rlike(r"commit|checksum|sha1|sha256|md5|digest|revision|etag|uuid|integrity|build")),
            "f_quoted": flag(F.col("after").rlike("^[\"']")),
            "f_pairs": F.regexp_count(low, F.lit(PAIRS)) / n, "f_steps": F.regexp_count(low, F.lit(STEPS)) / n,
            "f_longest": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(value, F.lit("[A-Za-z][a-z]+|[A-Z]+"), F.lit(0)), lambda w: F.length(w))), F.lit(0)) / n,
            "f_code": flag(value.rlike(CODE)),
            "f_number": flag(near.rlike(r"order|track|invoice|serial|version|number|isbn|class|request|image|alphabet|\bid\b|call|see")),
            "f_path": flag(F.lower("path").rlike(r"test|example|sample|fixture|docs?/|mock|readme")),
        }
    )


def labelled(spark: SparkSession, rows: int = 5000) -> DataFrame:
    """The built-in labelled findings, made by rule from row numbers: value, name, before, after, path, label (1: secret)."""
    return spark.range(rows).selectExpr(
        "id", "sha2(concat('finding', id), 256) AS h", "base64(unhex(sha2(concat('raw', id), 256))) AS b", "id % 20 AS kind", "id div 20 AS i",
    ).selectExpr(
        """CASE kind
          WHEN 0 THEN substr(h, 1, 40) WHEN 1 THEN substr(replace(b, '=', ''), 1, 24 + i % 19) WHEN 2 THEN concat('AKIA', upper(substr(translate(b, '+/=', 'xyz'), 1, 16)))
          WHEN 3 THEN concat('ghp_', substr(translate(b, '+/=', 'xyz'), 1, 36)) WHEN 4 THEN concat(substr(translate(b, '+/=', '!#$'), 1, 10 + i % 8))
          WHEN 5 THEN substr(h, 1, 16 + (i % 3) * 16)
          WHEN 6 THEN concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))
          WHEN 7 THEN substr(h, 1, 40)
          WHEN 8 THEN element_at(array('your_api_key_here1', 'changeme123', 'example-token-0000', 'xxxxxxxxxxxxxxxx1', '<your-token-1>', 'sample_secret_value_2'), CAST(i % 6 AS INT) + 1)
          WHEN 9 THEN concat_ws('_', element_at(array('get', 'set', 'update', 'import'), CAST(i % 4 AS INT) + 1), 'user', element_at(array('account', 'project', 'document'), CAST(i % 3 AS INT) + 1), 'version', CAST(i % 9 AS STRING))
          WHEN 10 THEN concat('/home/user/project/module', i % 7, '/index/page', i % 5)
          WHEN 11 THEN substr(h, 1, 32)
          WHEN 12 THEN concat(element_at(array('Default', 'Simple', 'Base', 'Async', 'Cached'), CAST(i % 5 AS INT) + 1), element_at(array('User', 'Order', 'Report', 'Session'), CAST(i % 4 AS INT) + 1), element_at(array('Controller', 'Repository', 'Service'), CAST(i % 3 AS INT) + 1), CAST(i % 9 + 1 AS STRING))
          WHEN 13 THEN concat(element_at(array('ORD', 'PO', 'REF', 'SN'), CAST(i % 4 AS INT) + 1), '-', lpad(CAST(i * 7919 % 1000000 AS STRING), 6 + CAST(i % 4 AS INT), '0'), '-', element_at(array('US', 'DE', 'JP'), CAST(i % 3 AS INT) + 1), CAST(i % 100 AS STRING), 'X')
          WHEN 14 THEN element_at(array('${DB_PASS_1}', '$(pass show db/main1)', 'config.get("db1")', 'settings.services.login1', 'os.environ["API1"]', '{{vault.db1}}'), CAST(i % 6 AS INT) + 1)
          WHEN 15 THEN concat(element_at(array('sha256-', 'sha384-', 'sha1-'), CAST(i % 3 AS INT) + 1), substr(translate(b, '+/', 'Az'), 1, 20 + i % 20))
          WHEN 16 THEN substr('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789abcdefghij', 30 + i % 20, 20 + i % 12)
          WHEN 17 THEN concat(element_at(array('river', 'Maple', 'stone', 'Falcon', 'cedar', 'Orbit'), CAST(i % 6 AS INT) + 1), CAST(i * 31 % 97 AS STRING), element_at(array('!', '#', '-', '$', '%'), CAST(i % 5 AS INT) + 1), element_at(array('Tiger', 'cloud', 'Pepper', 'signal'), CAST(i % 4 AS INT) + 1), element_at(array('', '42', '!', '7x'), CAST(i % 4 AS INT) + 1))
          WHEN 18 THEN concat(CAST(2000 + i % 30 AS STRING), '-', lpad(CAST(i % 12 + 1 AS STRING), 2, '0'), '-', lpad(CAST(i % 28 + 1 AS STRING), 2, '0'), element_at(array('-build-', '-nightly-', '-stable-'), CAST(i % 3 AS INT) + 1), CAST(i % 50 AS STRING))
          ELSE concat(CAST(i % 9 + 1 AS STRING), element_at(array('T', 'Q', 'HK'), CAST(i % 3 AS INT) + 1), lpad(CAST(i * 104729 % 100000000 AS STRING), 16, CAST(i % 10 AS STRING))) END AS value""",
        """CASE WHEN kind IN (0, 1, 4, 5, 8, 14, 17) THEN concat(element_at(array('token', 'password', 'secret', 'api_key', 'auth'), CAST(i % 5 AS INT) + 1), element_at(array(' = ', '=', ': '), CAST(i % 3 AS INT) + 1), IF(i % 2 = 0, '"', '')) ELSE '' END AS name""",
        """CASE WHEN kind = 7 THEN element_at(array('see commit ', 'at revision ', 'sha1 '), CAST(i % 3 AS INT) + 1) WHEN kind = 11 THEN element_at(array('md5 checksum ', 'digest: ', 'build '), CAST(i % 3 AS INT) + 1)
          WHEN kind = 12 THEN element_at(array('class ', 'new ', 'import '), CAST(i % 3 AS INT) + 1) WHEN kind = 13 THEN element_at(array('order ', 'invoice ', 'serial '), CAST(i % 3 AS INT) + 1)
          WHEN kind = 15 THEN element_at(array('integrity ', 'checksum ', 'digest '), CAST(i % 3 AS INT) + 1) WHEN kind = 19 THEN element_at(array('number ', 'track ', 'and the '), CAST(i % 3 AS INT) + 1)
          WHEN kind IN (2, 3) THEN element_at(array('key ', 'use ', 'export '), CAST(i % 3 AS INT) + 1) WHEN kind = 6 THEN 'id ' ELSE 'and the ' END AS before""",
        "CASE WHEN kind IN (0, 1, 4, 5, 8, 14, 17) AND i % 2 = 0 THEN '\" and' ELSE ' of the' END AS after",
        "IF(kind >= 8 AND kind <> 17 AND i % 3 = 0, 'tests/fixtures/a.txt', concat('src', i % 20)) AS path",
        "CAST(kind < 6 OR kind = 17 AS DOUBLE) AS label",
    )


def train(table: DataFrame, trees: int = 24, depth: int = 8) -> RandomForestClassificationModel:
    """A forest from labelled findings (the columns of candidates() that describe one, and label)."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(featured(table)).select("__features", "label")
    return RandomForestClassifier(featuresCol="__features", labelCol="label", numTrees=trees, maxDepth=depth, seed=11).fit(rows.coalesce(2))


def scan(documents: DataFrame, path: str | None = "source", table: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """All candidates with p_secret and is_secret: doc_id, ord, start, name, value, p_secret, is_secret."""
    model = train(labelled(documents.sparkSession) if table is None else table)
    model.setProbabilityCol("__probability").setPredictionCol("__prediction").setRawPredictionCol("__raw")
    rows = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(featured(candidates(documents, path)))
    scored = model.transform(rows).withColumn("p_secret", vector_to_array("__probability")[1])
    return scored.select("doc_id", "ord", "start", "name", "value", "p_secret", (F.col("p_secret") > threshold).alias("is_secret"))
