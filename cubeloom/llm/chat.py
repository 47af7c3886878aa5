"""Chat formatting by schema fingerprint, with DataFrame functions only.

A record is a VARIANT (or JSON text). Its nested field paths, types removed, are hashed; the hash selects a
declarative layout that says where the turns are. The turns become one text of marked turns with a loss mask
over the assistant texts. Control strings inside roles and texts are escaped reversibly: after escaping, a text
holds no ``#`` and no ``<``, so every mark in the output is a real one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm.common import query, table

TURN = "struct<role:string,text:string>"
OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>\n"
# every backslash of an escaped text leads one of these letters
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
TYPES = r"\b(STRING|VOID|BOOLEAN|BIGINT|DOUBLE|FLOAT|BINARY|DATE|TIMESTAMP_NTZ|TIMESTAMP|UUID|DECIMAL\(\d+,\s*\d+\))\b"


@dataclass(frozen=True)
class Layout:
    """Where a record keeps its turns: a list of role/text objects, or one field per role in order."""

    name: str
    example: str  # JSON with the layout's field paths
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()  # (role, path)
    roles: tuple[tuple[str, str], ...] = field(default=())  # (name in the record, canonical name)


LAYOUTS = (
    Layout("messages", '{"messages":[{"role":"","content":""}]}', turns="$.messages"),
    Layout("from_value", '{"conversations":[{"from":"","value":""}]}', turns="$.conversations", role="from", text="value",
           roles=(("human", "user"), ("gpt", "assistant"))),
    Layout("prompt", '{"prompt":"","response":""}', fields=(("user", "$.prompt"), ("assistant", "$.response"))),
    Layout("instruction", '{"instruction":"","input":"","output":""}',
           fields=(("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
)


def fingerprint(record: Column) -> Column:
    """Hash of a record's nested field paths, whatever the types of the leaves."""
    return F.xxhash64(F.regexp_replace(F.schema_of_variant(record), TYPES, "_"))


def _turns_of(record: Column, layout: Layout) -> Column:
    if layout.turns:
        kind = f"array<struct<`{layout.role}`:string,`{layout.text}`:string>>"
        names = dict(layout.roles)

        def canonical(turn: Column) -> Column:
            role = turn[layout.role]
            for old, new in names.items():
                role = F.when(turn[layout.role] == old, new).otherwise(role)
            return F.struct(role.alias("role"), turn[layout.text].alias("text"))

        return F.transform(F.try_variant_get(record, layout.turns, kind), canonical).cast(f"array<{TURN}>")
    turns = [F.struct(F.lit(role).alias("role"), F.try_variant_get(record, path, "string").alias("text")) for role, path in layout.fields]
    return F.array(*turns).cast(f"array<{TURN}>")


def canonical_turns(df: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Adds layout (null where no layout has the record's fingerprint) and turns (array of role and text)."""
    of = F.col(record) if dict(df.dtypes)[record] == "variant" else F.try_parse_json(F.col(record))
    print_ = fingerprint(of)
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(f"array<{TURN}>")
    for layout in layouts:
        same = print_ == fingerprint(F.parse_json(F.lit(layout.example)))
        name = F.when(same, layout.name).otherwise(name)
        turns = F.when(same, _turns_of(of, layout)).otherwise(turns)
    return df.withColumns({"layout": name, "turns": turns})


def escape(value: Column, role: bool = False) -> Column:
    for plain, coded in ESCAPES if role else ESCAPES[:-1]:
        value = F.replace(value, F.lit(plain), F.lit(coded))
    return value


def unescape(value: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        value = F.replace(value, F.lit(coded), F.lit(plain))
    return value


def format_chat(df: DataFrame, turns: str = "turns") -> DataFrame:
    """Adds formatted (marked turns in one text) and loss_spans (start, end of each assistant text, in code points).

    Null turns, roles and texts count as none and empty; an empty list gives an empty text. The spans are running
    sums of the turns' lengths, so they take a number per turn and not the text.
    """
    listed = F.coalesce(F.col(turns), F.array().cast(f"array<{TURN}>"))

    def head(turn: Column) -> Column:
        return F.concat(F.lit(OPEN), escape(F.coalesce(turn["role"], F.lit("")), role=True), F.lit(BETWEEN))

    def body(turn: Column) -> Column:
        return escape(F.coalesce(turn["text"], F.lit("")))

    parts = F.transform(
        listed,
        lambda t: F.struct(head(t).alias("head"), body(t).alias("body"), (F.coalesce(t["role"], F.lit("")) == "assistant").alias("loss")),
    )
    df = df.withColumn("_parts", parts)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["head"])
        end = begin + F.length(part["body"])
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        spans = F.when(part["loss"], F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((end + len(CLOSE)).alias("at"), spans.alias("spans"))

    spans = F.aggregate("_parts", start, step)["spans"]
    text = F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return df.withColumns({"formatted": text, "loss_spans": spans}).drop("_parts")


def read_chat(df: DataFrame, formatted: str = "formatted") -> DataFrame:
    """Adds turns_read: the roles and texts of a formatted chat."""

    def turn(piece: Column) -> Column:
        at = F.instr(piece, BETWEEN)
        role = F.substring(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(piece, at + len(BETWEEN), F.length(piece))).alias("text"))

    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")
    return df.withColumn("turns_read", F.transform(pieces, turn))


def loss_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(F.col(formatted), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), ""
    )


def records_of_rows(rows: DataFrame) -> DataFrame:
    """conv_id, record: one VARIANT per conversation, its rows in order of turn, then role, then text (null first).

    Pairs of user and assistant become a prompt record, a system line before such a pair an instruction record,
    other conversations with a system line a from/value record, and the rest a messages record.
    """
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    grouped = rows.groupBy("conv_id").agg(turns.alias("t"))
    roles = F.transform("t", lambda x: F.coalesce(x["role"], F.lit("")))

    def are(*names: str) -> Column:
        return roles == F.array(*map(F.lit, names))

    def text(i: int) -> Column:
        return F.get(F.col("t"), F.lit(i))["text"]

    def listed(role: str, body: str) -> Column:
        return F.transform("t", lambda x: F.struct(x["role"].alias(role), x["text"].alias(body)))

    record = (
        F.when(are("user", "assistant"), F.to_variant_object(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(are("system", "user", "assistant"),
              F.to_variant_object(F.struct(text(0).alias("instruction"), text(1).alias("input"), text(2).alias("output"))))
        .when(F.array_contains(roles, "system"), F.to_variant_object(F.struct(listed("from", "value").alias("conversations"))))
        .otherwise(F.to_variant_object(F.struct(listed("role", "content").alias("messages"))))
    )
    return grouped.select("conv_id", record.alias("record"))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Counts and checksums read back from formatted chats."""
    joined = F.array_join(F.transform("turns_read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read_chat(formatted).withColumn("_loss", loss_text())
    return read.select(
        "conv_id",
        F.size("turns_read").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SAID = "\\### Assistant: </turn> ok"

SQL = """
WITH c AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), e AS (
 SELECT *, replace(replace(replace(text, '\\', '\\b'), '#', '\\h'), '<', '\\l') AS body,
  replace(replace(replace(replace(role, '\\', '\\b'), '#', '\\h'), '<', '\\l'), ':', '\\c') AS head FROM c
)
SELECT conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
 CAST(sum(length(head) + length(body) + 14) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op8_chat", SQL)
def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(SAID).alias("text"),
    )
    return chat_digest(format_chat(canonical_turns(records_of_rows(rows.unionByName(added)))))
