"""Readers of record files, dataset layouts, and resumable output."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridelta.functions.layout import free_table
from veridelta.session import written


def read_json_list(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Files that are one JSON list of objects each; another one is an error here, malformed content when it is read."""
    firsts = spark.read.option("wholetext", True).text(path).select(F.regexp_extract("value", r"^\s*(\S)", 1).alias("c"))
    if not firsts.where("c <> '['").isEmpty():
        raise ValueError(f"{path} isn't a JSON list")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType, required: tuple[str, ...] = ()) -> DataFrame:
    """A file of JSON objects by line; a malformed line is an error when it is read."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return with_columns(rows, required)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): the lines of text files with their numbers from 1.

    Files stay splittable: lines are numbered within a split, and shifted by the lines of the splits before it."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"),
        "value",
    )
    # written once: a split's lines have consecutive ids within its task
    raw = written(raw, "lines")
    splits = raw.groupBy("file", "split").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # one row a split
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    line = (F.col("id") - F.col("first") + F.col("before") + 1).alias("line")
    return raw.join(splits, ["file", "split"]).select("file", line, "value")


def read_numbered_json(spark: SparkSession, path: str, schema: str | T.StructType, show: int = 5) -> DataFrame:
    """Files of JSON objects by line as rows with ``file`` and ``line``; blank lines are skipped. A line that isn't a JSON
    object, or whose values don't fit the schema, is an error that names its file and number, before anything is read."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = written(numbered_lines(spark, path).where(F.trim(F.regexp_replace("value", r"\s+", " ")) != ""), "numbered")
    known = T.StructType([*kind, T.StructField("__malformed", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__malformed"}
    parsed = lines.select("file", "line", F.from_json("value", known, options).alias("r"))
    bad = parsed.where(F.col("r").isNull() | F.col("r.__malformed").isNotNull())
    if first := bad.select("file", "line").orderBy("file", "line").limit(show).collect():
        places = ", ".join(f"{r.file.rpartition('/')[2]}:{r.line}" for r in first)
        raise ValueError(f"{bad.count()} malformed lines, of them {places}")
    return parsed.select("file", "line", *(F.col("r")[f.name].alias(f.name) for f in kind))


def with_columns(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """``df`` if it has the required columns."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return df


def not_empty(df: DataFrame) -> DataFrame:
    """``df`` if it has a row."""
    if df.isEmpty():
        raise ValueError("there are no rows")
    return df


def record_chunks(records: DataFrame, k: int) -> DataFrame:
    """(q_id, rank, id, text, score): each record's first k passages in stored order, the title on a line before the text.

    A record without passages is an error when it is read."""
    lacking = F.raise_error(F.concat(F.lit("no passages for "), F.col("q_id").cast("string"))).cast(records.schema["ctxs"].dataType)
    passages = F.when(F.coalesce(F.size("ctxs"), F.lit(0)) > 0, F.col("ctxs")).otherwise(lacking)
    own = records.select("q_id", F.posexplode(F.slice(passages, 1, k)).alias("rank", "c"))
    title = F.coalesce(F.col("c.title"), F.lit(""))
    text = F.when(title != "", F.concat(title, F.lit("\n"), F.col("c.text"))).otherwise(F.col("c.text"))
    return own.select("q_id", "rank", F.col("c.id").alias("id"), text.alias("text"), F.col("c.score").alias("score"))


def _query_id(prefix: str, *columns: str):
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("|", *columns), 256), 1, 16))


def _listed(rows: DataFrame, column: str):
    """A column as an array of strings: itself, or its one value."""
    kind = rows.select(column).schema[0].dataType
    return F.col(column).cast("array<string>") if isinstance(kind, T.ArrayType) else F.array(F.col(column).cast("string"))


EXAMPLE = ("query_id", "query", "gold_answers")


def open_questions(rows: DataFrame) -> DataFrame:
    """Questions with a list of answers, or one."""
    golds = _listed(rows, "answer")
    return rows.select(_query_id("nq", "question").alias("query_id"), F.col("question").alias("query"), golds.alias("gold_answers"))


def aliased_questions(rows: DataFrame) -> DataFrame:
    """Questions whose answers are aliases, or a single value without them."""
    golds = F.when(F.size("answer.aliases") > 0, F.col("answer.aliases")).otherwise(F.array("answer.value"))
    return rows.select(_query_id("tqa", "question").alias("query_id"), F.col("question").alias("query"), golds.alias("gold_answers"))


def multihop_questions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions, and one ``title: sentences`` chunk for each titled context."""
    own = rows.withColumn("query_id", _query_id("hotpot", "question"))
    questions = own.select("query_id", F.col("question").alias("query"), F.array("answer").alias("gold_answers"), "level", "type")
    zipped = F.arrays_zip(F.col("context.title").alias("title"), F.col("context.sentences").alias("sentences"))
    chunks = own.select("query_id", F.posexplode(zipped).alias("pos", "c"))
    text = F.concat_ws(": ", "c.title", F.array_join("c.sentences", " "))
    return questions, chunks.select("query_id", "pos", F.lit("text").alias("modality"), text.alias("text"))


def popularity_questions(rows: DataFrame) -> DataFrame:
    """Questions with possible answers as a JSON list or one string; the object where there are none."""
    listed = F.from_json("possible_answers", "array<string>")
    golds = F.coalesce(listed, F.when(F.col("possible_answers") != "", F.array("possible_answers")), F.array("obj"))
    return rows.select(_query_id("popqa", "question").alias("query_id"), F.col("question").alias("query"), golds.alias("gold_answers"), "s_pop")


def table_questions(rows: DataFrame, entry: str) -> tuple[DataFrame, DataFrame]:
    """Questions of entries with a table and paragraphs, and the chunks that all questions of an entry share.

    An answer is a list, a value, or text that holds a JSON list; a question without an id is named by its entry and place.
    Paragraphs are structs with a text, or texts. Tables are of one type, or VARIANT: then they may differ in form from entry to
    entry, and their chunks have text, headers and rows as ``table_context`` takes them."""
    fields = {f.name: f.dataType for f in rows.schema["questions"].dataType.elementType}
    has = lambda n: F.coalesce(F.col(f"q.{n}"), F.lit("")) if n in fields else F.lit("")
    answer = F.col("q.answer")
    if isinstance(fields["answer"], T.ArrayType):
        golds = answer.cast("array<string>")
    else:
        listed = F.when(answer.cast("string").startswith("["), F.from_json(answer.cast("string"), "array<string>"))
        golds = F.coalesce(listed, F.array(F.coalesce(answer.cast("string"), F.lit(""))))
    questions = rows.select(F.col(entry).alias("entry_id"), F.posexplode("questions").alias("n", "q"))
    own_id = F.concat_ws("_", F.lit("tatqa"), F.col("entry_id").cast("string"), F.col("n").cast("string"))
    questions = questions.select(
        "entry_id", F.coalesce(F.col("q.uid"), own_id).alias("query_id") if "uid" in fields else own_id.alias("query_id"),
        F.col("q.question").alias("query"), golds.alias("gold_answers"),
        *[has(n).alias(n) for n in ("answer_type", "scale", "derivation")],
    )
    # a table in free form has its layout's parts beside it
    free = isinstance(rows.schema["table"].dataType, T.VariantType)
    parts = [free_table(F.col("table")).alias("parts")] if free else []
    tables = rows.where(F.col("table").isNotNull()).select(
        F.col(entry).alias("entry_id"), F.lit(0).alias("pos"), F.lit("table").alias("modality"), F.lit(None).cast("string").alias("text"), "table", *parts
    )
    if free:
        tables = tables.withColumns({"text": F.col("parts.text"), "headers": F.col("parts.headers"), "rows": F.col("parts.rows")}).drop("parts")
    structs = isinstance(rows.schema["paragraphs"].dataType.elementType, T.StructType)
    texts = rows.select(F.col(entry).alias("entry_id"), F.posexplode("paragraphs").alias("pos", "p"))
    text = F.col("p.text") if structs else F.col("p").cast("string")
    texts = texts.select("entry_id", (F.col("pos") + 1).alias("pos"), F.lit("text").alias("modality"), text.alias("text"))
    return questions, tables.unionByName(texts, allowMissingColumns=True)


def multimodal_questions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions, and their text and image facts as chunks, told apart by whether they are evidence."""
    questions = rows.select(F.col("qid").alias("query_id"), F.col("Q").alias("query"), F.col("A").alias("gold_answers"), F.col("Qcate").alias("category"))
    parts = []
    for column, positive in (("img_posFacts", True), ("txt_posFacts", True), ("img_negFacts", False), ("txt_negFacts", False)):
        own = rows.select(F.col("qid").alias("query_id"), F.posexplode(column).alias("pos", "f"))
        image = column.startswith("img")
        text = F.col("f.caption") if image else F.coalesce(F.col("f.fact"), F.col("f.snippet"))
        parts.append(
            own.select("query_id", "pos", F.lit("image" if image else "text").alias("modality"), text.alias("text"),
                       (F.col("f.image_url") if image else F.lit(None).cast("string")).alias("image"), F.lit(positive).alias("is_positive"))
        )
    chunks = parts[0]
    for part in parts[1:]:
        chunks = chunks.unionByName(part)
    return questions, chunks


def unfinished(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``work`` whose key isn't in ``done`` yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def same_version(done: DataFrame, column: str, version: str) -> DataFrame:
    """``done`` if all its rows are of one version."""
    if not done.where(~F.col(column).eqNullSafe(F.lit(version))).isEmpty():
        raise ValueError(f"there are rows of another {column} than {version}")
    return done


def merged(base: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """A left merge in which ``more`` wins wherever it has the row, even by a null."""
    right = more.withColumn("__has", F.lit(True))
    both = [c for c in more.columns if c != key and c in base.columns]
    right = right.select(key, "__has", *[F.col(c).alias(f"__{c}") if c in both else F.col(c) for c in more.columns if c != key])
    out = base.join(right, key, "left")
    for c in both:
        out = out.withColumn(c, F.when(F.col("__has"), F.col(f"__{c}")).otherwise(F.col(c)))
    return out.drop("__has", *[f"__{c}" for c in both])


def append_json(df: DataFrame, path: str) -> None:
    """Rows appended as JSON lines."""
    df.write.mode("append").json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, in place of what was there."""
    df.write.mode("overwrite").json(path)


def write_summary(summary: DataFrame, path: str) -> None:
    """A table of one row as one JSON file, null figures included; more rows are an error."""
    if summary.limit(2).count() > 1:
        raise ValueError("a summary has one row")
    summary.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def predictions(answers: DataFrame, query: str, answer: str, scale: str) -> DataFrame:
    """(value): for each question one line of JSON, its id to the answer and its scale."""
    pair = F.array(F.coalesce(answer, F.lit("")), F.coalesce(scale, F.lit("")))
    return answers.select(F.to_json(F.create_map(F.col(query).cast("string"), pair)).alias("value"))


def iteration_log(steps: DataFrame, query: str, order: str) -> DataFrame:
    """``steps`` with ``iteration``, the place of each step in its question, from 0."""
    return steps.withColumn("iteration", F.row_number().over(Window.partitionBy(query).orderBy(order)) - 1)


def split_errors(rows: DataFrame, error: str) -> tuple[DataFrame, DataFrame]:
    """The rows without an error, and those with one."""
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())


def raise_failures(failed: DataFrame, key: str, error: str, show: int = 5) -> None:
    """An error that names the number of failed rows and the first of them, if there are any."""
    n = failed.count()
    if n:
        first = failed.orderBy(key).limit(show).collect()  # a few rows for the message
        raise RuntimeError(f"{n} rows failed: " + "; ".join(f"{r[key]}: {r[error]}" for r in first))


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``table``; a key that it lacks is an error."""
    missing = rows.join(table, keys, "left_anti").select(*keys).limit(5).collect()  # a few for the message
    if missing:
        raise KeyError(f"keys are missing: {[tuple(r) for r in missing]}")
    return rows.join(table, keys)


def setup_problems(spark: SparkSession, tables: dict[str, tuple[str, ...]]) -> list[str]:
    """What is wrong with the tables that a run needs: those that can't be read, are empty or lack columns."""
    out = []
    for path, columns in sorted(tables.items()):
        try:
            df = spark.read.parquet(path)
        except AnalysisException:
            out.append(f"{path}: can't be read")
            continue
        missing = sorted(set(columns) - set(df.columns))
        if missing:
            out.append(f"{path}: lacks {', '.join(missing)}")
        elif df.isEmpty():
            out.append(f"{path}: has no rows")
    return out


def count_problems(tables: dict[str, tuple[DataFrame, int]]) -> list[str]:
    """What is wrong with the sizes of tables: each with the number of rows that it should have."""
    found = ((name, df.count(), expected) for name, (df, expected) in sorted(tables.items()))
    return [f"{name}: {n} rows, {expected} expected" for name, n, expected in found if n != expected]


def uncovered(questions: DataFrame, evidence: str, corpus: DataFrame, url: str, key: str) -> DataFrame:
    """(key, url): what questions name as evidence (an array of urls) and the corpus lacks, repeats and nulls included."""
    named = questions.select(key, F.explode(evidence).alias("url"))
    return named.join(corpus.select(F.col(url).alias("__u")).distinct(), F.col("url") == F.col("__u"), "left_anti")


def check_setup(questions: DataFrame, evidence: str, corpus: DataFrame, url: str, key: str, n_questions: int, n_corpus: int) -> None:
    """An error if the numbers of questions and corpus rows aren't as expected, or the corpus lacks evidence."""
    problems = count_problems({"questions": (questions, n_questions), "corpus": (corpus, n_corpus)})
    if missing := uncovered(questions, evidence, corpus, url, key).count():
        problems.append(f"corpus: lacks {missing} urls of evidence")
    if problems:
        raise ValueError("; ".join(problems))


#: Each dataset's layout, kind of content, and metrics.
DATASETS = {
    "nq": (open_questions, "text", ("exact_match", "token_f1")),
    "triviaqa": (aliased_questions, "text", ("exact_match", "token_f1")),
    "hotpotqa": (multihop_questions, "text", ("exact_match", "token_f1")),
    "popqa": (popularity_questions, "text", ("exact_match", "token_f1")),
    "tatqa": (table_questions, "table", ("exact_match", "token_f1", "numeric")),
    "webqa": (multimodal_questions, "image", ("exact_match", "token_f1", "rouge_l")),
}


def dataset(name: str):
    """The layout, modality and metrics of a dataset."""
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(sorted(DATASETS))}")
    return DATASETS[name]
