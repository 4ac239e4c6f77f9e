"""Layouts of contexts, tables, images and prompts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridelta.functions.text import bound, stripped

# File endings and their types.
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp"}


def text_context(texts: Column) -> Column:
    """Numbered documents under a heading, or that there are none."""
    lines = F.transform(texts, lambda t, i: F.concat(F.lit("[Doc "), i + 1, F.lit("] "), t))
    return F.when(F.size(texts) > 0, F.concat(F.lit("Context:\n"), F.array_join(lines, "\n"))).otherwise(
        F.lit("[No context provided]")
    )


def _row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))


def table_markdown(headers: Column, rows: Column) -> Column:
    """A table in Markdown; short rows are padded, long ones cut."""
    n = F.size(headers)
    padded = F.transform(rows, lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), n)), 1, n))
    rule = F.array_repeat(F.lit("---"), n)
    lines = F.concat(F.array(_row(headers), _row(rule)), F.transform(padded, _row))
    return F.array_join(lines, "\n")


def listed_table(cells: Column) -> Column:
    """A table as a list of rows, the first of which holds the headers, in Markdown."""
    return F.when(F.size(cells) > 0, table_markdown(F.get(cells, F.lit(0)), F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))))).otherwise("")


def free_table(table: Column) -> Column:
    """A struct of headers, rows and text of a table in free form, a VARIANT: an object with ``headers`` and ``rows``, a list of
    rows of which the first holds the headers, or text.

    Cells are texts, numbers as JSON writes them, ``True``, ``False`` or ``None``. What has no rows, as text, an empty list
    or a list of texts, has null for them; what has no headers has null for those; ``text`` is the text itself, else the table's JSON."""
    form = F.schema_of_variant(table)
    is_object, is_text = form.startswith("OBJECT"), form == "STRING"
    listed = F.try_variant_get(table, "$", "array<array<variant>>")
    cells = lambda row: F.transform(row, _cell)

    def parts(lists: Column, heads: Column, rows: Column) -> Column:
        filled = F.when(F.size(lists) > 0, lists)
        first = F.get(filled, F.lit(0))
        heads = F.when(is_object, heads).otherwise(first)
        rest = F.when(first.isNotNull(), F.slice(filled, F.lit(2), F.greatest(F.size(filled) - 1, F.lit(0))))
        rows = F.when(is_object, F.coalesce(rows, F.array().cast("array<array<variant>>"))).otherwise(rest)
        return F.struct(
            F.when(F.size(heads) > 0, cells(heads)).alias("headers"),
            F.transform(rows, cells).alias("rows"),
            F.when(is_text, F.try_variant_get(table, "$", "string")).otherwise(F.to_json(table)).alias("text"),
        )

    return bound(
        parts,
        lists=listed,
        heads=F.try_variant_get(table, "$.headers", "array<variant>"),
        rows=F.try_variant_get(table, "$.rows", "array<array<variant>>"),
    )


def _cell(value: Column) -> Column:
    """A cell's text; a list or an object within a cell is JSON."""
    own = F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value))
    flag = own.isin("true", "false") & (F.schema_of_variant(value) == "BOOLEAN")
    return F.when(value.isNull() | F.is_variant_null(value), "None").when(flag, F.initcap(own)).otherwise(own)


def free_layout(parts: Column, form: str = "markdown") -> Column:
    """The parts of a table in free form as ``markdown``, in one line (``linear``), or as its ``text``; as text where it has no
    headers or, in one line, no rows."""
    shown = {
        "markdown": F.when(parts["headers"].isNotNull(), table_markdown(parts["headers"], parts["rows"])),
        "linear": F.when(parts["rows"].isNotNull(), table_linear(parts["headers"], parts["rows"])),
        "text": parts["text"],
    }[form]
    return F.coalesce(shown, parts["text"])


def table_linear(headers: Column, rows: Column) -> Column:
    """``header: cell`` pairs; a missing header is named by its place."""
    pair = lambda c, j: F.concat(F.coalesce(F.get(headers, j), F.concat(F.lit("col"), j)), F.lit(": "), c)
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, pair), "; ")), " | ")


def mime_type(path: Column) -> Column:
    """The type of an image by its ending; JPEG where it is unknown."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.try_element_at(known, ending), F.lit("image/jpeg"))


def image_label(caption: Column) -> Column:
    """What stands for an image in a text."""
    return F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.lit("[Image: "), caption, F.lit("]"))).otherwise(
        F.lit("[Image]")
    )


def evidence_paragraph(titles: Column, texts: Column, k: int) -> Column:
    """The first k passages, numbered, each under its title."""
    both = F.slice(F.arrays_zip(titles.alias("title"), texts.alias("text")), 1, k)
    lines = F.transform(both, lambda p, i: F.concat(F.lit("["), i + 1, F.lit("] "), p["title"], F.lit("\n"), p["text"]))
    return F.array_join(lines, "\n")


def query_of_claims(claims: Column) -> Column:
    """The search text of a list of claims."""
    return F.array_join(claims, " ")


def guidance(claims: Column, most: int = 5) -> Column:
    """The leading concept's first claims as a hint for the final answer."""
    return F.array_join(F.slice(claims, 1, most), "; ")


NO_CONTEXT = "[No context provided]"


def table_context(chunks: Column, form: str = "markdown") -> Column:
    """Numbered tables and texts under a heading. ``chunks``: structs of modality, text, headers and rows; a table without
    headers and rows is its text, and with form ``text`` each is."""

    def block(c: Column, i: Column) -> Column:
        table = F.concat(F.lit("[TABLE "), i + 1, F.lit("]\n"), free_layout(c, form), F.lit("\n"))
        return F.when(c["modality"] == "table", table).otherwise(F.concat(F.lit("[TEXT "), i + 1, F.lit("] "), c["text"], F.lit("\n")))

    blocks = F.concat(F.array(F.lit("Context:\n")), F.transform(chunks, block))
    return F.when(F.size(chunks) > 0, F.array_join(blocks, "\n")).otherwise(NO_CONTEXT)


def _block(kind: str, text=None, url=None, detail=None) -> Column:
    none = F.lit(None).cast("string")
    own = [(kind, "type"), (text, "text"), (url, "url"), (detail, "detail")]
    return F.struct(*[(none if v is None else F.lit(v) if isinstance(v, str) else v).cast("string").alias(n) for v, n in own])


def image_context(chunks: Column, detail: str = "high") -> Column:
    """Content blocks (type, text, url, detail) of texts and images. ``chunks``: structs of modality, text, caption and image,
    which is a url or base64, with its type in ``mime`` where it was read from a file."""

    def blocks(c: Column, i: Column) -> Column:
        label = F.concat(F.lit("[Image "), i + 1, F.lit("]"))
        label = F.when(F.coalesce(c["caption"], F.lit("")) != "", F.concat(label, F.lit(" Caption: "), c["caption"])).otherwise(label)
        is_url = c["image"].startswith("http://") | c["image"].startswith("https://")
        inline = F.concat(F.lit("data:"), F.coalesce(c["mime"], F.lit("image/jpeg")), F.lit(";base64,"), c["image"])
        image = F.array(_block("text", label), _block("image_url", url=F.when(is_url, c["image"]).otherwise(inline), detail=detail))
        text = F.array(_block("text", F.concat(F.lit("[Text "), i + 1, F.lit("] "), c["text"], F.lit("\n"))))
        return F.when(c["modality"] == "image", image).otherwise(text)

    return F.when(
        F.size(chunks) > 0, F.concat(F.array(_block("text", "Context:\n")), F.flatten(F.transform(chunks, blocks)))
    ).otherwise(F.array(_block("text", NO_CONTEXT)))


def image_base64(content: Column) -> Column:
    """A file's bytes in base64, in one line."""
    return F.regexp_replace(F.base64(content), r"\s", "")


def chunk_label(modality: Column, text: Column, caption: Column, headers: Column, rows: Column) -> Column:
    """What stands for a chunk in a text: a table in one line, an image's caption, or the text itself."""
    return F.when(modality == "table", F.coalesce(table_linear(headers, rows), text)).when(
        modality == "image", image_label(caption)
    ).otherwise(text)


def prompt_messages(question: Column, blocks: Column, system: Column | None = None) -> Column:
    """Messages (role, content): the system's if there is one, and the user's with context and question."""
    asked = _block("text", F.concat(F.lit("\nQuestion: "), question, F.lit("\nAnswer:")))
    user = F.struct(F.lit("user").alias("role"), F.concat(blocks, F.array(asked)).alias("content"))
    if system is None:
        return F.array(user)
    own = F.struct(F.lit("system").alias("role"), F.array(_block("text", system)).alias("content"))
    return F.when(F.coalesce(system, F.lit("")) != "", F.array(own, user)).otherwise(F.array(user))


def filled(template: Column, **values: Column) -> Column:
    """A template with each ``{name}`` replaced by its value."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def prompts(rows: DataFrame, templates: DataFrame, model: str, template: str, **values: Column) -> DataFrame:
    """``rows`` with ``prompt``: the template of their model's kind, filled. ``templates`` (kind, template) holds a row for each
    kind of model; a model whose name holds none of the kinds is an error."""
    kinds = templates.select(F.col("kind").alias("__kind"), F.col(template).alias("__t"))
    # a few kinds of model
    joined = rows.join(F.broadcast(kinds), F.lower(F.col(model)).contains(F.lower("__kind")), "left")
    known = F.coalesce("__t", F.raise_error(F.concat(F.lit("no template for model "), F.col(model))).cast("string"))
    return joined.withColumn("prompt", filled(known, **values)).drop("__kind", "__t")


def document_block(documents: Column) -> Column:
    """Numbered documents (title, source, published_at, text) with where and when they appeared."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    lines = F.transform(
        documents,
        lambda d, i: F.concat(
            F.lit("["), i + 1, F.lit("] "), d["title"], F.lit("\nSource: "), empty(d["source"]), F.lit("; Date: "),
            empty(d["published_at"]), F.lit("\n"), d["text"],
        ),
    )
    return F.array_join(lines, "\n\n")


def compact_documents(documents: Column) -> Column:
    """Documents with id, title, url and score alone."""
    return F.transform(documents, lambda d: F.struct(*[d[c].alias(c) for c in ("id", "title", "url", "score")]))


# How a question, its answers and the two choices are laid out.
CHOICES = "Is the possible answer:\nA) True\nB) False\nThe possible answer is:"


def truth_shot(question: Column, answer: Column, samples: Column, correct: Column) -> Column:
    """A worked example: the answer itself stands before the samples, and the choice after them."""
    lines = F.transform(F.concat(F.array(answer), samples), lambda a: F.concat(stripped(a), F.lit(" \n")))
    label = F.when(correct, " A").otherwise(" B")
    return F.concat(
        F.lit("Question: "), question, F.lit("\nBrainstormed Answers: "), F.array_join(lines, ""), F.lit("Possible answer: "),
        answer, F.lit("\n" + CHOICES), label,
    )


def truth_prompt(question: Column, answer: Column, samples: Column, shots: Column | None = None) -> Column:
    """A question whose choice is open: the answer itself stands after the samples."""
    lines = F.transform(F.concat(samples, F.array(answer)), lambda a: F.concat(stripped(a), F.lit("\n")))
    own = F.concat(
        F.lit("Question: "), question, F.lit("\nBrainstormed Answers: "), F.array_join(lines, ""), F.lit("Possible answer: "),
        answer, F.lit("\n" + CHOICES),
    )
    return own if shots is None else F.concat(F.when(F.coalesce(shots, F.lit("")) != "", F.concat(shots, F.lit("\n"))).otherwise(""), own)


def shot_block(shots: Column) -> Column:
    """Worked examples, one after another."""
    return F.array_join(shots, "\n")
