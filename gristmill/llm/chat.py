"""Chat formatting by schema fingerprints, in DataFrame expressions only.

*Schemas.*  A record's fingerprint is the hash of its nested field paths, which come from the schema of its variant;
an array's are those of all its elements.  A layout is known by the paths that it needs.  For each layout the record's
paths are restricted to the layout's and hashed; the layouts whose own hash that is fit, and the one with most paths is
taken.  It is a declarative mapping: where the turns are, and which path gives the role and the text of each.  So other
fields never hide a layout, and records of one table may have different ones: whole conversations, pairs of prompt and
answer, or single turns that are put together by their conversation.  A record that none fits is returned with a reason.

*Template.*  ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  In texts a backslash is doubled and ``<|``
becomes ``<\\|``, so a text can't hold a control string and is got back exactly; roles are percent-encoded where
needed.  The loss mask is the list of spans of the assistant's texts in the formatted string.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.llm.columns import let

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A mapping from one layout to turns.

    ``paths`` are the paths that select it.  ``turns`` lists (role, path) of single texts, or ``each`` names the array
    whose elements have their role and text at ``role`` and ``text``.  A record that is a single turn has its role and
    text there, and its conversation at ``key`` and place at ``order``.
    """

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    key: str = ""
    order: str = ""


# Field names of layouts in common use.
LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), each="messages", role="role", text="content"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), each="conversations", role="from", text="value"),
    Layout("turn_rows", ("conv_id", "role", "text", "turn"), role="role", text="text", key="conv_id", order="turn"),
    Layout("prompt_completion", ("completion", "prompt"), (("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), (("user", "prompt"), ("assistant", "response"))),
    Layout("system_prompt_response", ("prompt", "response", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("instruction", "output"), (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", ("input", "instruction", "output"), (("user", "instruction\n\ninput"), ("assistant", "output"))),
    Layout("question_answer", ("answer", "question"), (("user", "question"), ("assistant", "answer"))),
)
# Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Most specific first.
BY_PATHS = sorted(LAYOUTS, key=lambda layout: -len(layout.paths))
#: Columns of a table that some layout knows.
KNOWN_COLUMNS = frozenset(p.split(".")[0].removesuffix("[]") for layout in LAYOUTS for p in layout.paths)


def nested_paths(schema: Column) -> Column:
    """All field paths, sorted, of a variant's schema as ``schema_of_variant`` writes it; ``[]`` marks elements."""
    parts = F.regexp_extract_all(schema, F.lit(r"(?:`(?:[^`]|``)+`|\w+): |OBJECT<|ARRAY<|>"), F.lit(0))
    zero = F.struct(F.lit("").alias("at"), F.array().cast("array<string>").alias("within"), F.array().cast("array<string>").alias("paths"))

    def step(acc: Column, part: Column) -> Column:
        bare = F.substring(part, F.lit(1), F.length(part) - 2)
        name = F.when(F.startswith(part, F.lit("`")), F.replace(F.substring(bare, F.lit(2), F.length(bare) - 2), F.lit("``"), F.lit("`"))).otherwise(bare)
        above = F.coalesce(F.try_element_at(acc["within"], F.lit(-1)), F.lit(""))
        named, elements = F.when(above == "", name).otherwise(F.concat_ws(".", above, name)), F.concat(acc["at"], F.lit("[]"))
        is_name, is_array = F.endswith(part, F.lit(": ")), part == "ARRAY<"
        within = F.when(is_name, acc["within"]).when(part == ">", F.slice(acc["within"], F.lit(1), F.greatest(F.lit(0), F.size(acc["within"]) - 1)))
        within = within.when(is_array, F.array_append(acc["within"], elements)).otherwise(F.array_append(acc["within"], acc["at"]))
        return F.struct(F.when(is_name, named).when(is_array, elements).otherwise(acc["at"]).alias("at"), within.alias("within"), F.when(is_name, F.array_append(acc["paths"], named)).otherwise(acc["paths"]).alias("paths"))

    return F.array_sort(F.aggregate(parts, zero, step, lambda acc: acc["paths"]))


def path_hash(paths: Column) -> Column:
    """Fingerprint of sorted paths."""
    return F.xxhash64(F.array_join(paths, "\n"))


def fits(layout: Layout, paths: Column) -> Column:
    """Whether a record's paths, restricted to those of a layout, have the layout's fingerprint."""
    own = F.array(*map(F.lit, sorted(layout.paths)))
    return path_hash(F.array_intersect(paths, own)) == path_hash(own)


def canonical_role(role: Column) -> Column:
    role = F.coalesce(role, F.lit(""))
    out = role
    for old, new in ROLES.items():
        out = F.when(F.lower(role) == old, F.lit(new)).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _mapped(layout: Layout, record: Column) -> Column:
    def at(path: str) -> Column:
        return F.try_variant_get(record, f"$.{path}", "string")

    if layout.each:
        items = F.try_variant_get(record, f"$.{layout.each}", "array<variant>")
        return F.transform(items, lambda m: _turn(canonical_role(F.try_variant_get(m, f"$.{layout.role}", "string")), F.try_variant_get(m, f"$.{layout.text}", "string")))
    if layout.key:
        return F.array(_turn(F.coalesce(at(layout.role), F.lit("")), at(layout.text)))
    return F.array(*(_turn(F.lit(role), F.concat_ws("\n\n", *(F.nullif(at(p), F.lit("")) for p in path.split("\n\n"))) if "\n\n" in path else at(path)) for role, path in layout.turns))


def turns_of(record: Column) -> Column:
    """Struct of fingerprint, layout, turns, reason (why there are no turns), conv_id and place of a variant."""

    def chosen(v: Column, paths: Column) -> Column:
        name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
        key, place = F.lit(None).cast("string"), F.lit(None).cast("decimal(38,9)")
        for layout in reversed(BY_PATHS):
            hit = fits(layout, paths)
            name, turns = F.when(hit, F.lit(layout.name)).otherwise(name), F.when(hit, _mapped(layout, v)).otherwise(turns)
            if layout.key:
                key = F.when(hit, F.try_variant_get(v, f"$.{layout.key}", "string")).otherwise(key)
                place = F.when(hit, F.try_variant_get(v, f"$.{layout.order}", "decimal(38,9)")).otherwise(place)
        reason = F.when(v.isNull(), "not a record").when(name.isNull(), "no layout")
        return F.struct(path_hash(paths).alias("fingerprint"), name.alias("layout"), turns.cast(TURNS).alias("turns"), reason.alias("reason"), key.alias("conv_id"), place.alias("place"))

    return let(record, lambda v: let(F.coalesce(nested_paths(F.schema_of_variant(v)), F.array().cast("array<string>")), lambda paths: chosen(v, paths)))


def turns_of_records(table: DataFrame, column: str = "record") -> DataFrame:
    """``table`` with ``fingerprint``, ``layout``, ``turns`` and ``reason`` of the JSON texts in ``column``.

    Columns of these names are replaced, no row is dropped: where no layout fits, or the JSON can't be read, layout and
    turns are null and the reason says so.
    """
    new = ("fingerprint", "layout", "turns", "reason")
    kept = F.struct(*(F.col(f"`{c}`") for c in table.columns if c not in new))
    return table.select(kept.alias("row"), turns_of(F.try_parse_json(F.col(f"`{column}`"))).alias("made")).select("row.*", *(f"made.{c}" for c in new))


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: Column) -> Column:
    """The conversation in the template."""
    one = F.transform(turns, lambda t: F.concat(F.lit(OPEN), F.url_encode(t["role"]), F.lit("\n"), escape(t["text"]), F.lit(CLOSE + "\n")))
    return F.array_join(one, "")


def _parts(formatted: Column) -> Column:
    """The turns of a formatted string as they stand there: without their marks, still escaped."""
    return F.transform(F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p != ""), lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))


def _role(part: Column) -> Column:
    return F.url_decode(F.substring_index(part, "\n", 1))


def _text(part: Column) -> Column:
    return F.substring(part, F.length(F.substring_index(part, "\n", 1)) + 2, F.length(part))


def parse_turns(formatted: Column) -> Column:
    """The turns that a formatted string holds."""
    return F.transform(_parts(formatted), lambda p: F.struct(_role(p).alias("role"), unescape(_text(p)).alias("text")))


def loss_mask(formatted: Column, role: str = "assistant") -> Column:
    """Spans (start, end) of a role's texts in a formatted string, code points from 0, the end exclusive."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + len(OPEN) + F.length(F.substring_index(p, "\n", 1)) + 1
        end = acc["at"] + len(OPEN) + F.length(p)
        spans = F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))
        return F.struct((end + len(CLOSE) + 1).alias("at"), F.when(_role(p) == role, spans).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(_parts(formatted), zero, step, lambda acc: acc["spans"])


def masked_texts(formatted: Column, mask: Column) -> Column:
    """What stands under a mask, unescaped."""
    return F.transform(mask, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"])))


def format_conversations(table: DataFrame, column: str | None = None) -> DataFrame:
    """conv_id, layout, fingerprint, reason, turns, formatted and mask of each conversation.

    :param column: JSON texts, one record each; without it each row of the table is a record, made of the columns that
        some layout knows.

    Records that are single turns are put together by conv_id, in order of turn; ties go by role and text.  Of other
    records each is a conversation, with a null conv_id.  One that no layout fits is returned as well, with a reason
    and without turns.  Null texts and roles count as empty.  An empty table gives no rows, a null conv_id is a
    conversation.  A conversation is one row, so it must fit a task; other columns are ignored.
    """
    kind = table.schema["conv_id"].dataType if column is None and "conv_id" in table.columns else T.StringType()
    known = [F.col(f"`{c}`") for c in table.columns if c in KNOWN_COLUMNS]
    record = F.to_variant_object(F.struct(*known)) if column is None and known else F.try_parse_json(F.col(f"`{column}`") if column else F.lit(None).cast("string"))
    judged = table.select(turns_of(record).alias("made"), F.monotonically_increasing_id().alias("id")).select("made.*", "id")
    single = F.col("layout").isin([layout.name for layout in LAYOUTS if layout.key])
    alone = judged.withColumn("id", F.when(~F.coalesce(single, F.lit(False)), F.col("id")))
    grouped = alone.groupBy("id", "conv_id").agg(F.min("layout").alias("layout"), F.min("fingerprint").alias("fingerprint"), F.min("reason").alias("reason"), F.sort_array(F.collect_list(F.struct("place", "turns"))).alias("all"))
    made = grouped.select(F.col("conv_id").cast(kind).alias("conv_id"), "layout", "fingerprint", "reason", F.flatten(F.transform("all", lambda t: t["turns"])).alias("turns"))
    made = made.withColumn("formatted", format_turns(F.col("turns")))
    return made.withColumn("mask", loss_mask(F.col("formatted")))


def digests(table: DataFrame) -> DataFrame:
    """What can be read back from the formatted conversations of a table of turn rows."""
    made = format_conversations(table).select("conv_id", "formatted", "mask")
    read = made.withColumn("turns", parse_turns(F.col("formatted"))).withColumn("loss", F.array_join(masked_texts(F.col("formatted"), F.col("mask")), ""))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
