"""Operator 7 [native]: chat formatting by schema fingerprints.

A record is a JSON object in one of many layouts, or a row of a table with turns as columns.  Its fingerprint is the hash of those of its
sorted nested field paths (``messages[].role`` and the like, the elements of a list taken together) that any layout uses, so
other fields (ids, names, sources) do not matter.  The fingerprint selects a declarative ``Layout`` that says where
roles and texts are, and its projection gives the canonical turns, an array of (role, text).  Where no layout has just these paths,
the one with the most paths that are all there is taken (of equals the first listed); an empty list has no turns.  Records without any
layout get null turns, so none is lost.  Rows of a table go the same way: the turns of a conversation are gathered in a struct, whose nested
field paths are fingerprinted like JSON's, and the layout found by it reads the struct.

The template writes a turn as ``<s>`` role ``[INST]`` text ``[/INST]</s>``.  Within roles and texts every
backslash is doubled and one is put inside each control string, so no control string is left in them
and the change can be undone exactly.  The loss mask is a list of (start, end) code-point ranges of the formatted
string, one for each assistant text.

Turns are ordered by (turn, role, text); null texts and roles are empty; null turn numbers come first;
repeated rows are repeated turns; rows with a null conversation id form one conversation.  Texts have no limit of their own: rows never
become JSON, and JSON is read with strings of any length that a JVM string can have.  An empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismframe.llm.common import table

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where a layout keeps its turns: either in a ``list`` of objects with a ``role`` and a ``text``
    field, or in ``fields``, (role, field names joined by a blank line) in order."""

    name: str
    paths: tuple[str, ...]
    list: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    system: str | None = None
    #: Whether the names that ``ROLES`` lists are turned into canonical ones.
    rename: bool = True


LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), "messages"),
    Layout("messages+system", ("messages[].content", "messages[].role", "system"), "messages", system="system"),
    Layout("turns", ("turns[].role", "turns[].text"), "turns", text="text", rename=False),
    Layout("from-value", ("conversations[].from", "conversations[].value"), "conversations", "from", "value"),
    Layout("prompt-completion", ("completion", "prompt"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt-response", ("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("question-answer", ("answer", "question"), fields=(("user", ("question",)), ("assistant", ("answer",)))),
    Layout("instruction", ("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction-input", ("input", "instruction", "output"), fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("nested-data", ("data.answer", "data.question"), fields=(("user", ("data.question",)), ("assistant", ("data.answer",)))),
)
#: Names that layouts give to the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


#: Strings of JSON records may be as long as a JVM string.
_JSON = {"maxStringLen": "2147483647"}


def known_paths(layouts: tuple[Layout, ...] = ()) -> list[str]:
    """The field paths that layouts use, and their lists themselves (as empty ones have no paths below)."""
    every = layouts or LAYOUTS
    return sorted({p for one in every for p in one.paths} | {one.list for one in every if one.list})


def field_paths(record: Column) -> Column:
    """The sorted nested field paths of a JSON object, two levels deep."""
    empty = F.expr("cast(array() as array<string>)")
    fields = F.from_json(record, "map<string,string>", _JSON)

    def below(k: Column) -> Column:
        value = F.try_element_at(fields, k)
        elements = F.from_json(F.when(value.startswith("["), value), "array<map<string,string>>", _JSON)
        inner = F.when(value.startswith("["), F.array_distinct(F.flatten(F.transform(elements, lambda e: F.coalesce(F.map_keys(e), empty)))))
        inner = inner.when(value.startswith("{"), F.map_keys(F.from_json(F.when(value.startswith("{"), value), "map<string,string>", _JSON)))
        mark = F.when(value.startswith("["), F.lit("[].")).otherwise(F.lit("."))
        return F.when(F.size(inner) > 0, F.transform(inner, lambda i: F.concat(k, mark, i))).otherwise(F.array(k))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_keys(fields), below))))


def struct_paths(kind: T.StructType) -> list[str]:
    """The field paths that a struct of this type may have, two levels deep, with its lists themselves."""
    out = []
    for field in kind:
        listed = isinstance(field.dataType, T.ArrayType)
        inner = field.dataType.elementType if listed else field.dataType
        below = inner.names if isinstance(inner, T.StructType) else []
        out += [f"{field.name}{'[].' if listed else '.'}{name}" for name in below] + [field.name] * (listed or not below)
    return out


def struct_field_paths(record: Column, kind: T.StructType) -> Column:
    """The sorted nested field paths of a struct, two levels deep; null fields count as missing."""

    def of(field: T.StructField) -> Column:
        every = [p for p in struct_paths(T.StructType([field])) if p != field.name]
        some = F.array(*map(F.lit, every or [field.name]))
        if isinstance(field.dataType, T.ArrayType):
            some = F.when(F.size(record[field.name]) > 0, some).otherwise(F.array(F.lit(field.name)))
        return F.when(record[field.name].isNotNull(), some).otherwise(F.expr("cast(array() as array<string>)"))

    return F.array_sort(F.array_distinct(F.concat(*map(of, kind))))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _read(record: Column, kind: str, of: T.StructType | None) -> Column:
    """A record's fields: of JSON those of ``kind``, of a struct its own."""
    return record if of else F.from_json(record, kind, _JSON)


def _field(record: Column, path: str, of: T.StructType | None = None) -> Column:
    """The text of a field, one or two levels deep."""
    name, _, below = path.partition(".")
    kind = f"struct<`{name}`:struct<`{below}`:string>>" if below else f"struct<`{name}`:string>"
    value = _read(record, kind, of)[name]
    return value[below] if below else value


def _turns(layout: Layout, record: Column, of: T.StructType | None = None) -> Column:
    if layout.list:
        kind = f"struct<`{layout.list}`:array<struct<`{layout.role}`:string,`{layout.text}`:string>>>"
        turns = F.transform(
            _read(record, kind, of)[layout.list],
            lambda t: F.struct(F.coalesce(t[layout.role], F.lit("")).alias("role"), F.coalesce(t[layout.text], F.lit("")).alias("text")),
        )
    else:
        get = lambda f: F.coalesce(_field(record, f, of), F.lit(""))
        turns = F.array(
            *(
                F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*map(get, names)), lambda x: x != ""), "\n\n").alias("text"))
                for role, names in layout.fields
            )
        )
    if layout.system:
        head = F.struct(F.lit("system").alias("role"), F.coalesce(_field(record, layout.system, of), F.lit("")).alias("text"))
        turns = F.concat(F.array(head), turns)
    if not layout.rename:
        return turns
    names = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.transform(turns, lambda t: F.struct(F.coalesce(F.try_element_at(names, t["role"]), t["role"]).alias("role"), t["text"].alias("text")))


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """records, JSON strings or structs, with ``fingerprint``, ``layout`` (null if unknown) and ``turns`` (null if unknown)."""
    kind = records.schema[record].dataType
    kind = kind if isinstance(kind, T.StructType) else None
    known = F.array(*map(F.lit, known_paths(layouts)))
    out = records.withColumn("_paths", F.array_sort(F.array_intersect(struct_field_paths(F.col(record), kind) if kind else field_paths(F.col(record)), known)))
    out = out.withColumn("fingerprint", fingerprint(F.col("_paths")))
    of = lambda paths: F.array(*map(F.lit, sorted(paths)))
    exact, held, turns = F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for layout in reversed(layouts):
        exact = F.when(F.col("fingerprint") == fingerprint(of(layout.paths)), F.lit(layout.name)).otherwise(exact)
    for layout in sorted(layouts, key=lambda one: -len(one.paths))[::-1]:
        held = F.when(F.size(F.array_except(of(layout.paths), F.col("_paths"))) == 0, F.lit(layout.name)).otherwise(held)
    for layout in reversed([one for one in layouts if one.list]):
        paths = {p for p in layout.paths if not p.startswith(f"{layout.list}[]")} | {layout.list}
        exact = F.coalesce(exact, F.when(F.col("fingerprint") == fingerprint(of(paths)), F.lit(layout.name)))
    out = out.withColumn("layout", F.coalesce(exact, held))
    there = struct_paths(kind) if kind else ()
    for layout in layouts:
        if kind and not set(layout.paths) <= set(there):
            continue  # a struct without these fields cannot have the layout
        turns = F.when(F.col("layout") == layout.name, _turns(layout, F.col(record), kind)).otherwise(turns)
    return out.withColumn("turns", turns).drop("_paths")


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"(<(?=/?s>)|\[(?=/?INST\]))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_turns(turns: Column) -> Column:
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit("<s>"), escape(t["role"]), F.lit("[INST]"), escape(t["text"]), F.lit("[/INST]</s>"))), ""
    )


def loss_mask(turns: Column) -> Column:
    """The ranges of assistant texts in the formatted string."""

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.lit(len("<s>[INST]")) + F.length(escape(t["role"]))
        end = start + F.length(escape(t["text"]))
        span = F.when(t["role"] == "assistant", F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.expr("cast(array() as array<struct<start:int,end:int>>)"))
        return F.struct((end + F.lit(len("[/INST]</s>"))).alias("at"), F.concat(acc["spans"], span).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("spans"))
    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string."""
    pieces = F.filter(F.split(formatted, "</s>"), lambda p: p != "")
    role = lambda p: F.substring_index(F.substring(p, 4, F.length(p)), "[INST]", 1)
    body = lambda p: F.substring_index(F.substring(p, F.length(role(p)) + 10, F.length(p)), "[/INST]", 1)
    return F.transform(pieces, lambda p: F.struct(unescape(role(p)).alias("role"), unescape(body(p)).alias("text")))


def format_turn_rows(found: DataFrame) -> DataFrame:
    return found.withColumns({"formatted": format_turns(F.col("turns")), "loss": loss_mask(F.col("turns"))})


def format_chats(records: DataFrame, record: str = "record") -> DataFrame:
    """records with fingerprint, layout, turns, formatted and loss (the mask)."""
    return format_turn_rows(canonical_turns(records, record))


def turns_of_rows(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) -> (conv_id, fingerprint, layout, turns), from the columns as they are: the fingerprint of each
    conversation's fields selects the layout that reads them."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    records = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns")).select("conv_id", F.struct("turns").alias("record"))
    return canonical_turns(records).select("conv_id", "fingerprint", "layout", "turns")


def records_of_rows(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) -> one JSON record in the ``turns`` layout for each conversation."""
    return turns_of_rows(rows).select("conv_id", F.to_json(F.struct("turns")).alias("record"))


def recorded(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) -> (conv_id, record), JSON in the layout that suits each: a prompt and its completion, or a list of messages with
    or without a system text before it, where roles have canonical names; a list of turns otherwise."""
    t = F.col("turns")
    roles = F.transform("turns", lambda x: x["role"])
    message = lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))
    plain = F.forall("turns", lambda x: ~x["role"].isin(*ROLES))
    pair = roles == F.array(F.lit("user"), F.lit("assistant"))
    system = (F.size("turns") > 1) & (F.get(roles, F.lit(0)) == "system")
    record = (
        F.when(pair, F.to_json(F.struct(F.get(t, F.lit(0))["text"].alias("prompt"), F.get(t, F.lit(1))["text"].alias("completion"), F.col("conv_id").alias("id"))))
        .when(plain & system, F.to_json(F.struct(F.get(t, F.lit(0))["text"].alias("system"), F.transform(F.slice("turns", 2, 1 << 30), message).alias("messages"))))
        .when(plain, F.to_json(F.struct(F.transform("turns", message).alias("messages"), F.lit("table").alias("source"))))
        .otherwise(F.to_json(F.struct("turns")))
    )
    return conversations.select("conv_id", record.alias("record"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    extra = spark.sql("select -7L as conv_id, turn, role, '</s>[INST] ok [/INST]' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    held = turns_of_rows(rows.unionByName(extra))
    # every second conversation comes as JSON, in the layout that suits it
    as_json = F.pmod(F.coalesce("conv_id", F.lit(1)), F.lit(2)) == 0
    one = held.where(~as_json).select("conv_id", "fingerprint", "layout", "turns")
    other = canonical_turns(recorded(held.where(as_json))).select("conv_id", "fingerprint", "layout", "turns")
    out = format_turn_rows(one.unionByName(other)).withColumn("back", read_turns(F.col("formatted")))
    masked = F.array_join(F.transform("loss", lambda r: unescape(F.substring(F.col("formatted"), r["start"] + 1, r["end"] - r["start"]))), "")
    plain = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.withColumn("masked", masked).select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(plain, 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "layout",
    )


OP7_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(20 + length(role) + length(text) + len(regexp_extract_all(role || chr(10) || text, '\\|</?s>|\[/?INST\]'))) as bigint) as formatted_chars,
  case when conv_id % 2 <> 0 or conv_id is null then 'turns'
    when list(role order by turn nulls first, role, text) = ['user', 'assistant'] then 'prompt-completion'
    when count(*) filter (role in ('human', 'gpt', 'bot', 'model')) > 0 then 'turns'
    when count(*) > 1 and first(role order by turn nulls first, role, text) = 'system' then 'messages+system' else 'messages' end as layout
from rows group by conv_id
"""
