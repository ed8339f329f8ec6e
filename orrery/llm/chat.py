"""Chat formatting in Spark expressions only.

A conversation's turns are collected as structs and sorted as an array. Runs of
adjacent turns of one role are slices of that array, and each is aggregated
into one block; blocks are concatenated with control strings between them::

    <|turn|>role<|text|>first text<|also|>second text<|end|>

A run is merged by array_join, in time linear in its length, as aggregate()
would copy what it has so far for every turn. Offsets are prefix sums of the
turns' lengths by aggregate() over slices, in two levels of about sqrt(n)
turns each, so that n turns take n * sqrt(n) additions.

Control strings inside roles and texts are broken up by a backslash, and
backslashes doubled, so that ``unescape(escape(x)) == x`` for any x.

The loss mask is a list of (start, length) spans of the formatted string, in
code points: one per assistant text, without control strings.

Defined results: null texts and roles are empty strings; turns sort by turn
(nulls first), then role, then text, so that ties and repeated rows have one
order; an empty table gives an empty result; a null conv_id is a conversation
of its own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, ALSO, END = "<|turn|>", "<|text|>", "<|also|>", "<|end|>"
#: Where one of these begins inside a text, a backslash goes after its first
#: character: every "<|", and the marks of other public templates.
_CONTROL = r"<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=/?INST\])"


def escape(c: Column) -> Column:
    doubled = F.regexp_replace(c, r"\\", r"\\\\")
    return F.regexp_replace(doubled, _CONTROL, r"$0\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def prefix_sums(lengths: str) -> Column:
    """For a column of array<long>, the sums before each item, by block and
    within it."""
    n = F.size(lengths)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    upto = lambda k: F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1)
    sums = F.transform(upto(F.ceil(n / width).cast("int")), lambda b: _total(F.slice(lengths, b * width + 1, width)))

    def placed(sums: Column) -> Column:
        heads = F.transform(sums, lambda _, b: _total(F.slice(sums, F.lit(1), b)))
        own = lambda h: F.transform(lengths, lambda _, i: F.get(h, F.floor(i / width).cast("int")) + _total(F.slice(lengths, i - i % width + 1, i % width)))
        return F.get(F.transform(F.array(heads), own), F.lit(0))

    return F.get(F.transform(F.array(sums), placed), F.lit(0))


def format_conversations(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start,length>> (start from 0).

    One shuffle, by conversation."""
    turn = F.struct(
        F.col("turn").isNotNull().alias("numbered"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    step = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))

    def marked(x: Column, i: Column) -> Column:
        new = (i == 0) | (x["role"] != F.get("t", i - 1)["role"])
        return F.struct(x["role"].alias("role"), escape(x["text"]).alias("body"), new.alias("new"))

    step = step.select("conv_id", F.transform("t", marked).alias("t"))
    step = step.withColumn("starts", F.filter(F.transform("t", lambda x, i: F.when(x["new"], i)), lambda i: i.isNotNull()))

    def merged(start: Column, k: Column) -> Column:
        run = F.slice("t", start + 1, F.coalesce(F.get("starts", k + 1), F.size("t")) - start)
        texts = F.array_join(F.transform(run, lambda x: x["body"]), ALSO)
        return F.concat(F.lit(TURN), escape(F.get("t", start)["role"]), F.lit(TEXT), texts, F.lit(END))

    step = step.withColumn("formatted", F.array_join(F.transform("starts", merged), ""))
    # what stands before each turn's text, the end of the run before included
    first, later = F.length(F.lit(TURN + TEXT)), F.length(F.lit(ALSO))
    head = lambda x, i: F.when(x["new"], first + F.length(escape(x["role"])) + F.when(i > 0, F.length(F.lit(END))).otherwise(0)).otherwise(later)
    step = step.withColumn("lengths", F.transform("t", lambda x, i: (head(x, i) + F.length(x["body"])).cast("long")))
    step = step.withColumn("before", prefix_sums("lengths"))

    def span(x: Column, i: Column) -> Column:
        size = F.length(x["body"]).cast("long")
        stop = F.get("before", i) + F.get("lengths", i)
        return F.when(x["role"] == loss_role, F.struct((stop - size).alias("start"), size.alias("length")))

    spans = F.filter(F.transform("t", span), lambda s: s.isNotNull())
    return step.select("conv_id", "formatted", spans.alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """array<struct<role,text>> read back from a formatted string, one per turn."""
    blocks = F.filter(F.split(formatted, r"<\|turn\|>"), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.regexp_replace(F.element_at(F.split(b, r"<\|text\|>", 2), 2), r"<\|end\|>\z", ""), r"<\|also\|>"),
                lambda x: F.struct(unescape(F.element_at(F.split(b, r"<\|text\|>", 2), 1)).alias("role"), unescape(x).alias("text")),
            ),
        )
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the mask, unescaped, in order, with nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), ""
    )
