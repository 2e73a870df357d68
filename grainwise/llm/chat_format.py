"""Chat formatting by schema fingerprints, with DataFrame operations only.

A record is JSON of any of several layouts (messages, conversations, prompt and response,
instruction and input, question and answer).  The nested field paths of a record, over all
items of its arrays and ``levels`` deep, sorted, are its schema; their hash selects a
declarative mapping, which says where turns, roles and texts are.  A schema with further
fields, whose hash no mapping lists, takes the first mapping all of whose needed paths it
has.  The mapped turns are canonical: (role, text) in order.

The template writes ``<turn ROLE>`` newline TEXT ``</turn>`` newline for each turn.  In
roles and texts the escape character and the two characters that start or end a marker are
escaped (``\\`` as ``\\b``, ``<`` as ``\\l``, ``>`` as ``\\g``); no text can therefore form or break a
marker, and reading back is exact.  The loss mask covers each assistant text as it stands
in the output, as (start, length) in code points.

Defined results: a null text or role is the empty one; turns with equal numbers are
ordered by role, then text; a null turn comes first; repeated turns are kept; a null
conv_id is a conversation; an empty list of turns formats as the empty text.  ``status``
is "mapped", or says why a record has no turns: "null record", "no JSON object", "unknown
schema"; mapping is null then.  Texts have no length limit of their own; a conversation
must fit into a task, as its digest needs the whole.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN_TYPE = "array<struct<role:string,text:string>>"

# speakers' names in the layouts.
ROLES = {"human": "user", "user": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "assistant": "assistant", "model": "assistant", "system": "system"}

SPEAKERS = {"user": "human", "assistant": "gpt", "system": "system"}


@dataclass(frozen=True)
class Mapping:
    """A layout: the turns are the items of ``turns`` (with ``role`` and ``text`` fields), or one for each (role, field) of ``fields``."""

    name: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()
    speakers: bool = False  # roles are speakers' names, translated by ROLES

    def needed(self) -> list[str]:
        """The paths without which this mapping can't be read."""
        if self.turns:
            return [self.turns, f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"]
        return [f for _, f in self.fields if f not in self.optional]

    def schemas(self) -> list[str]:
        """The path lists that name this mapping outright."""
        if self.turns:  # a list without items has no paths below it
            return ["|".join(sorted(self.needed())), self.turns]
        return ["|".join(sorted(self.needed() + list(more))) for n in range(len(self.optional) + 1) for more in _choices(self.optional, n)]

    def ddl(self) -> str:
        if self.turns:
            return f"`{self.turns}` array<struct<`{self.role}`:string,`{self.text}`:string>>"
        return ", ".join(f"`{f}` string" for _, f in self.fields)


def _choices(items: tuple[str, ...], n: int) -> list[tuple[str, ...]]:
    from itertools import combinations

    return list(combinations(items, n))


# Known layouts.
MAPPINGS = (
    Mapping("messages", turns="messages"),
    Mapping("conversations", turns="conversations", role="from", text="value", speakers=True),
    Mapping("turns", turns="turns", role="role", text="text"),
    Mapping("prompt_response", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Mapping("prompt_completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("instruction", fields=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output")), optional=("system", "input")),
    Mapping("question_answer", fields=(("user", "question"), ("assistant", "answer"))),
)


def parsed_as(record: Column, ddl: str) -> Column:
    """A JSON text as the type; Spark's own limit of 20,000,000 characters a string is lifted, which its other JSON functions keep."""
    return F.from_json(record, ddl, {"maxStringLen": str(2**31 - 1)})


def _escaped_key(key: Column) -> Column:
    """A field's name in a path: the characters that paths are made with are written as ~ and a digit."""
    for character, code in (("~", "~0"), (".", "~1"), ("[", "~2"), ("|", "~3")):
        key = F.replace(key, F.lit(character), F.lit(code))
    return key


def _paths(value: Column, levels: int) -> Column:
    """The field paths below a JSON text, which is an object, a list (all of whose items are read; one that is no object has an empty name) or anything else."""
    none = F.array().cast("array<string>")
    if levels == 0:
        return none
    start = F.substring(F.ltrim(value), 1, 1)

    def of_field(e: Column) -> Column:
        key, inner = _escaped_key(e["key"]), F.substring(F.ltrim(e["value"]), 1, 1)
        joint = F.when(inner == "[", F.concat(key, F.lit("[]."))).otherwise(F.concat(key, F.lit(".")))
        below = F.when(inner.isin("[", "{"), F.transform(_paths(e["value"], levels - 1), lambda x: F.concat(joint, x))).otherwise(none)
        return F.concat(F.array(key), below)

    def of_map(fields: Column) -> Column:
        return F.coalesce(F.flatten(F.transform(F.map_entries(fields), of_field)), none)

    def of_object(text: Column) -> Column:
        return of_map(parsed_as(text, "map<string,string>"))

    def of_items(objects: Column) -> Column:
        """Items are mostly objects all; a list with others is read item by item."""
        each = F.transform(parsed_as(value, "array<string>"), lambda x: F.when(F.substring(F.ltrim(x), 1, 1) == "{", of_object(x)).otherwise(F.array(F.lit(""))))
        return F.array_distinct(F.flatten(F.when(objects.isNotNull() & ~F.exists(objects, lambda x: x.isNull()), F.transform(objects, of_map)).otherwise(each)))

    of_list = F.get(F.transform(F.array(parsed_as(value, "array<map<string,string>>")), of_items), F.lit(0))
    return F.when(start == "{", F.array_distinct(of_object(value))).when(start == "[", F.coalesce(of_list, none)).otherwise(none)


def schema_paths(record: Column, levels: int = 3) -> Column:
    """The sorted field paths of a JSON record, as one string."""
    return F.array_join(F.array_sort(F.array_distinct(_paths(record, levels))), "|")


def fingerprint(paths: Column) -> Column:
    return F.substring(F.sha2(paths, 256), 1, 16)


def mapped(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds schema_hash, mapping, status and turns (canonical) to records."""
    import hashlib

    known = {hashlib.sha256(s.encode()).hexdigest()[:16]: m.name for m in reversed(mappings) for s in m.schemas()}
    df = records.withColumn("schema_paths", schema_paths(F.col(record))).withColumn("schema_hash", fingerprint(F.col("schema_paths")))
    listed = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))[F.col("schema_hash")]
    paths = F.split("schema_paths", r"\|")
    contained = F.coalesce(*(F.when(F.size(F.array_except(F.array(*map(F.lit, m.needed())), paths)) == 0, F.lit(m.name)) for m in mappings))
    df = df.withColumn("mapping", F.coalesce(listed, contained))
    is_object = F.startswith(F.ltrim(F.col(record)), F.lit("{")) & parsed_as(F.col(record), "map<string,string>").isNotNull()
    df = df.withColumn("status", F.when(F.col("mapping").isNotNull(), "mapped").when(F.col(record).isNull(), "null record").when(~is_object, "no JSON object").otherwise("unknown schema")).drop("schema_paths")
    turns = F.lit(None).cast(TURN_TYPE)
    for m in mappings:
        parsed = parsed_as(F.col(record), m.ddl())
        if m.turns:
            made = _turns(parsed, m)
        else:
            given = [F.struct(F.lit(r).alias("role"), parsed[f].alias("text")) for r, f in m.fields]
            made = F.filter(F.array(*given), lambda t: t["text"].isNotNull())
        turns = F.when(F.col("mapping") == m.name, made).otherwise(turns)
    return df.withColumn("turns", turns)


def _turns(parsed: Column, m: Mapping) -> Column:
    names = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    role = lambda c: F.coalesce(*([names[F.lower(c)]] if m.speakers else []), c, F.lit(""))
    return F.transform(parsed[m.turns], lambda t: F.struct(role(t[m.role]).alias("role"), F.coalesce(t[m.text], F.lit("")).alias("text")))


def escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")), F.lit("\\b"), F.lit("\\"))


def formatted(turns: Column) -> Column:
    """The template over canonical turns."""
    one = lambda t: F.concat(F.lit("<turn "), escaped(t["role"]), F.lit(">\n"), escaped(t["text"]), F.lit("</turn>\n"))
    return F.array_join(F.transform(turns, one), "")


def read_back(output: Column) -> Column:
    """Canonical turns from an output of ``formatted``."""
    pieces = F.filter(F.split(output, "</turn>\n"), lambda x: x != "")

    def one(x: Column) -> Column:
        cut = F.instr(x, ">\n")
        return F.struct(unescaped(F.substr(x, F.lit(7), cut - 7)).alias("role"), unescaped(F.substr(x, cut + 2)).alias("text"))

    return F.transform(pieces, one)


def loss_spans(turns: Column) -> Column:
    """(start from 0, length) in code points of each assistant text in the output, in order.

    Starts are running sums, kept in blocks of turns, so that work stays below the square of
    their number.
    """
    sized = F.transform(turns, lambda t: F.struct((t["role"] == "assistant").alias("loss"), F.length(escaped(t["role"])).alias("head"), F.length(escaped(t["text"])).alias("body")))
    block = F.greatest(F.ceil(F.sqrt(F.size(turns))), F.lit(1)).cast("int")
    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.size(turns) - 1, block), lambda i: F.slice(all_, i + 1, block))
    blocks = F.when(F.size(turns) > 0, F.get(F.transform(F.array(sized), cut), F.lit(0))).otherwise(F.array().cast("array<array<struct<loss:boolean,head:int,body:int>>>"))
    one = F.array().cast("array<struct<start:int,length:int>>")

    def turn(a: Column, t: Column) -> Column:
        start = a["at"] + t["head"] + 8  # "<turn " and ">\n"
        spans = F.when(t["loss"], F.concat(a["spans"], F.array(F.struct(start.alias("start"), t["body"].alias("length"))))).otherwise(a["spans"])
        return F.struct((start + t["body"] + 8).alias("at"), spans.alias("spans"))  # "</turn>\n"

    def whole(a: Column, b: Column) -> Column:
        done = F.aggregate(b, F.struct(a["at"].alias("at"), one.alias("spans")), turn)
        return F.struct(done["at"].alias("at"), F.concat(a["parts"], F.array(done["spans"])).alias("parts"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,length:int>>>").alias("parts"))
    return F.flatten(F.aggregate(blocks, zero, whole)["parts"])


def records_of(rows: DataFrame) -> DataFrame:
    """(conv_id, record): rows by turn as one JSON record for each conversation, in one of four layouts by a hash of conv_id.

    A layout that can't say what a conversation holds gives way to ``messages``: speakers'
    names need the three common roles, prompt and response one turn of each.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    speaker = F.create_map(*(F.lit(x) for pair in SPEAKERS.items() for x in pair))
    kind = F.pmod(F.xxhash64("conv_id"), F.lit(4))
    items = lambda role, text, name=lambda r: r: F.transform("t", lambda x: F.struct(name(x["role"]).alias(role), x["text"].alias(text)))
    made = (
        F.when((kind == 1) & F.forall(roles, lambda r: r.isin(*SPEAKERS)), F.to_json(F.struct(items("from", "value", lambda r: speaker[r]).alias("conversations"))))
        .when(kind == 2, F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), items("role", "text").alias("turns"))))
        .when((kind == 3) & (F.array_join(roles, ",") == "user,assistant"), F.to_json(F.struct(F.get("t", F.lit(0))["text"].alias("prompt"), F.get("t", F.lit(1))["text"].alias("response"))))
        .otherwise(F.to_json(F.struct(items("role", "content").alias("messages"))))
    )
    return grouped.select("conv_id", made.alias("record"))


def format_chats(records: DataFrame, record: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds schema_hash, mapping, status, formatted and loss_spans to records, and drops the record."""
    made = [x for x in records.columns if x.lower() not in ("schema_paths", "schema_hash", "mapping", "status", "turns", "formatted", "loss_spans")]
    df = mapped(records.select(*made), record, mappings).withColumn("turns", F.coalesce("turns", F.array().cast(TURN_TYPE)))
    return df.withColumn("formatted", formatted(F.col("turns"))).withColumn("loss_spans", loss_spans(F.col("turns"))).drop("turns", record)
