"""Nested records to related flat tables, by a tree automaton over their shapes.

A record is a tree. The automaton runs bottom-up: a leaf gets its state from its kind (``NULL``, ``BLANK``,
``TEXT``, ``NUMBER``, ``FLAG``), an inner node from its kind and the states of its members, typed states of the nodes
below included (an embed by its fields' states, an emotion by its users'). ``Rule`` names the
member states that lead to a typed state; the first rule that fits wins, and a node that fits none gets the
catch-all state of its family. States below ``ENTRY`` (null, empty text, empty object) are no entries.

The transitions are compiled to Catalyst expressions over VARIANT, so that a record is parsed once, all its
nodes are classified in one projection and the children leave through one ``explode``: no shuffle, no Python.

Every child row keeps the supertype's keys (record key, ``child_kind``, ``pos``, ``sub_pos``) whatever its typed
state, so subtype tables of one kind can be united or joined to their parents at any time.

Defined results: a null record or column has no children; text that is not one valid JSON value has none; a record
that repeats a member's name has the entries of its first member of that name; a single object in place of an array is an array of one; arrays kept as
JSON text are read as arrays; an entry that is none keeps its index; a record that is there twice gives its
children twice; columns of the input beside the named ones are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorewell.session import written

NULL, BLANK, HOLLOW = "NULL", "BLANK", "HOLLOW"  # no entries: null, empty text, empty object
TEXT, NUMBER, FLAG, LIST, OBJECT = "TEXT", "NUMBER", "FLAG", "LIST", "OBJECT"


def _path(v: Column, *names: str) -> Column:
    for n in names:
        v = F.call_function("try_variant_get", v, F.lit(f"$.{n}"), F.lit("variant"))
    return v


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: inside lambdas, common subexpressions aren't found."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def leaf_state(v: Column) -> Column:
    """The automaton's state of a node before any typed rule: its kind."""
    text = F.call_function("try_variant_get", v, F.lit("$"), F.lit("string"))
    return _let(
        F.call_function("schema_of_variant", v),
        lambda shape: F.when(shape.isNull() | (shape == "VOID"), NULL)
        .when(shape == "STRING", F.when(text == "", BLANK).otherwise(TEXT))
        .when(shape == "OBJECT<>", HOLLOW)
        .when(shape.startswith("OBJECT"), OBJECT)
        .when(shape.startswith("ARRAY"), LIST)
        .when(shape == "BOOLEAN", FLAG)
        .otherwise(NUMBER),
    )


def _is_entry_state(state: Column) -> Column:
    return ~state.isin(NULL, BLANK, HOLLOW)


def is_entry(v: Column) -> Column:
    """Null, empty text and the empty object are no entries."""
    return _is_entry_state(leaf_state(v))


def parsed(text: Column) -> Column:
    """JSON text as VARIANT; null unless the whole text is one valid value."""
    get = lambda boxed, path: F.call_function("try_variant_get", boxed, F.lit(path), F.lit("variant"))
    boxed = F.call_function("try_parse_json", F.concat(F.lit("["), text, F.lit("]")))
    return _let(boxed, lambda b: F.when(get(b, "$[1]").isNull(), get(b, "$[0]")))


def _unwrapped(v: Column) -> Column:
    """A node, or what its JSON text holds."""
    text = F.call_function("try_variant_get", v, F.lit("$"), F.lit("string"))
    return F.when(leaf_state(v) == TEXT, parsed(text)).otherwise(v)


def entries(v: Column) -> Column:
    """A node as array<variant>: arrays as they are, an object as an array of one, JSON text parsed, else empty."""
    return _let(_unwrapped(v), lambda u: _let(leaf_state(u), lambda state: (
        F.when(state == LIST, F.call_function("try_variant_get", u, F.lit("$"), F.lit("array<variant>")))
        .when(state == OBJECT, F.array(u))
        .otherwise(F.array().cast("array<variant>"))
    )))


@dataclass(frozen=True)
class Rule:
    """A typed state and the member states that lead to it; a member that is not named may have any state.

    A member's state is its kind, or a typed state of the family ``typed`` names for it: those are found first (the
    automaton runs bottom-up), and a member that is a list has the state ``<family>_list`` if all its entries have typed
    states of that family that a rule names, else ``<family>_mixed``."""

    state: str
    members: dict[str, tuple[str, ...]] = field(default_factory=dict)
    kind: str = OBJECT
    typed: dict[str, str] = field(default_factory=dict)

    def fits(self, v: Column, state: Column) -> Column:
        test = state == self.kind
        for name, states in self.members.items():
            member = _path(v, name)
            test = test & (list_state(self.typed[name], member) if name in self.typed else leaf_state(member)).isin(*states)
        return test


def list_state(family: str, v: Column) -> Column:
    """The state of a member that holds entries of a family: ``<family>_none``, ``<family>_list`` or ``<family>_mixed``."""
    return _let(F.filter(F.transform(entries(v), lambda w: AUTOMATA[family].classify(w)), lambda x: x.isNotNull()), lambda found: (
        F.when(F.size(found) == 0, f"{family}_none").when(F.exists(found, lambda x: x == f"{family}_other"), f"{family}_mixed").otherwise(f"{family}_list")
    ))


class Automaton:
    """The typed states of one family of nodes. ``classify`` gives the state, ``rules`` in order of preference."""

    def __init__(self, family: str, rules: list[Rule]):
        self.family, self.rules = family, rules

    @property
    def states(self) -> list[str]:
        return [r.state for r in self.rules] + [f"{self.family}_other"]

    def classify(self, v: Column) -> Column:
        """The state of an entry; null for a node that is none."""

        def typed(state: Column) -> Column:
            chain = F.when(~_is_entry_state(state), None)
            for rule in self.rules:
                chain = chain.when(rule.fits(v, state), rule.state)
            return chain.otherwise(f"{self.family}_other")

        return _let(leaf_state(v), typed)


_SOME = (TEXT,)
_COUNT = (NUMBER,)

AUTOMATA = {
    "attachment": Automaton("attachment", [
        Rule("attachment_visual", {"width": _COUNT, "height": _COUNT}),
        Rule("attachment_stored", {"doc_id": _SOME}),
        Rule("attachment_named", {"name": _SOME}),
    ]),
    "embed": Automaton("embed", [
        Rule("embed_signed_fields", {"fields": ("embed_field_list",), "author": (OBJECT,)}, typed={"fields": "embed_field"}),
        Rule("embed_with_fields", {"fields": ("embed_field_list", "embed_field_mixed")}, typed={"fields": "embed_field"}),
        Rule("embed_titled", {"title": _SOME}),
    ]),
    "embed_field": Automaton("embed_field", [
        Rule("embed_field_number", {"value": _COUNT}),
        Rule("embed_field_text", {"value": _SOME}),
        Rule("embed_field_blank", {"name": _SOME}),
    ]),
    "emotion": Automaton("emotion", [
        Rule("emotion_used", {"key": _SOME, "users": ("reaction_list",)}, typed={"users": "reaction"}),
        Rule("emotion_mixed", {"key": _SOME, "users": ("reaction_mixed",)}, typed={"users": "reaction"}),
        Rule("emotion_unused", {"key": _SOME}),
    ]),
    "reaction": Automaton("reaction", [
        Rule("reaction_timed", {"DisplayName": _SOME, "time": _COUNT}),
        Rule("reaction_untimed", {"DisplayName": _SOME}),
    ]),
    "file": Automaton("file", [
        Rule("file_sized", {"fileName": _SOME, "size": _COUNT}),
        Rule("file_named", {"fileName": _SOME}),
    ]),
    "quote": Automaton("quote", [
        Rule("quote_signed", {"messageId": _SOME, "sender": _SOME}),
        Rule("quote_plain", {"messageId": _SOME}),
    ]),
    "preview": Automaton("preview", [
        Rule("preview_link", {"value": (OBJECT,)}),
    ]),
    "amsref": Automaton("amsref", [Rule("amsref_id", kind=TEXT)]),
}

#: The typed columns of each kind's tables: name, path in the node, type.
COLUMNS: dict[str, list[tuple[str, str, str]]] = {
    "attachment": [("doc_id", "$.doc_id", "string"), ("name", "$.name", "string"), ("size", "$.size", "bigint"), ("width", "$.width", "int"), ("height", "$.height", "int"), ("url", "$.url", "string")],
    "embed": [("type", "$.type", "string"), ("title", "$.title", "string"), ("author", "$.author.name", "string")],
    "embed_field": [("name", "$.name", "string"), ("value", "$.value", "string")],
    "emotion": [("key", "$.key", "string")],
    "reaction": [("display_name", "$.DisplayName", "string"), ("time", "$.time", "bigint")],
    "file": [("file_name", "$.fileName", "string"), ("item_id", "$.itemid", "string"), ("size", "$.size", "bigint")],
    "quote": [("message_id", "$.messageId", "string"), ("sender", "$.sender", "string")],
    "preview": [("key", "$.key", "string"), ("url", "$.value.url", "string"), ("title", "$.value.title", "string")],
    "amsref": [("ref", "$", "string")],
}

_CHILD = "struct<child_kind:string,pos:int,sub_pos:int,shape:string,node:variant>"


def _children(kind: str, nodes: Column) -> Column:
    """The entries of array<variant> as child rows."""
    rows = F.transform(nodes, lambda v, i: F.struct(
        F.lit(kind).alias("child_kind"), i.alias("pos"), F.lit(-1).alias("sub_pos"),
        AUTOMATA[kind].classify(v).alias("shape"), v.alias("node"),
    ))
    return F.filter(rows, lambda r: r["shape"].isNotNull()).cast(f"array<{_CHILD}>")


def _grandchildren(kind: str, nodes: Column, member: str) -> Column:
    """The entries of an array that each node of array<variant> holds."""
    rows = F.flatten(F.transform(nodes, lambda v, i: F.transform(entries(_path(v, member)), lambda w, j: F.struct(
        F.lit(kind).alias("child_kind"), i.alias("pos"), j.alias("sub_pos"),
        AUTOMATA[kind].classify(w).alias("shape"), w.alias("node"),
    ))))
    return F.filter(rows, lambda r: r["shape"].isNotNull()).cast(f"array<{_CHILD}>")


def child_rows(decoded: DataFrame, parents: bool = False) -> DataFrame:
    """One row per child entry: rec_id, child_kind, pos, sub_pos, shape (the automaton's state), node (variant).

    ``parents`` adds the emotions, whose keys (rec_id, pos) are the parent link of reactions as an embed's are of its
    fields. A record that repeats a member's name is valid JSON that VARIANT refuses as a whole; its lists are then read
    by path, each by itself."""
    message = F.col("message")
    base = decoded.select("rec_id", "message", parsed(message).alias("m"), "attachments", "embeds")
    p = _unwrapped(_path(F.col("m"), "properties"))
    refused = F.when(F.col("m").isNull() & message.rlike(r"^\s*\{"), F.from_json(message, "map<string,string>").isNotNull()).otherwise(F.lit(False))
    base = base.select("rec_id", "message", "m", p.alias("p"), refused.alias("refused"), "attachments", F.transform(F.col("embeds"), lambda e: parsed(e)).alias("embeds"))

    def part(name: str) -> Column:
        own = _path(F.col("m" if name == "amsreferences" else "p"), name)
        path = f"$.{name}" if name == "amsreferences" else f"$.properties.{name}"
        return entries(F.when(F.col("refused"), parsed(F.get_json_object(message, path))).otherwise(own))

    attachment = next((f.dataType.elementType for f in decoded.schema if f.name == "attachments" and isinstance(f.dataType, T.ArrayType)), None)
    if isinstance(attachment, T.StructType):
        names = attachment.names
        hollow = lambda a: F.coalesce(*[a[n].cast("string") for n in names]).isNull()
        attachments = F.transform(F.col("attachments"), lambda a: F.when(a.isNotNull() & ~hollow(a), F.call_function("to_variant_object", a)))
    else:
        attachments = F.transform(F.col("attachments"), lambda a: parsed(a))
    emotions = part("emotions")
    children = F.concat(*[F.coalesce(x, F.array().cast(f"array<{_CHILD}>")) for x in (
        _children("attachment", attachments),
        _children("embed", F.col("embeds")),
        _grandchildren("embed_field", F.col("embeds"), "fields"),
        *([_children("emotion", emotions)] if parents else []),
        _grandchildren("reaction", emotions, "users"),
        _children("file", part("files")),
        _children("quote", part("qtdMsgs")),
        _children("preview", part("urlpreviews")),
        _children("amsref", part("amsreferences")),
    )])
    return base.select("rec_id", F.explode(children).alias("c")).select("rec_id", "c.child_kind", "c.pos", "c.sub_pos", "c.shape", "c.node")


def subtype_table(children: DataFrame, kind: str, shape: str | None = None) -> DataFrame:
    """The typed table of one kind (of one shape, if named), with the supertype's keys and the typed columns."""
    rows = children.where(F.col("child_kind") == kind)
    if shape:
        rows = rows.where(F.col("shape") == shape)
    typed = [F.call_function("try_variant_get", F.col("node"), F.lit(path), F.lit(kind_)).alias(name) for name, path, kind_ in COLUMNS[kind]]
    return rows.select("rec_id", "child_kind", "pos", "sub_pos", "shape", *typed)


def record_table(decoded: DataFrame) -> DataFrame:
    """The parents: one row per record with its scalar members."""
    m = parsed(F.col("message"))
    text = lambda name: F.call_function("try_variant_get", F.col("m"), F.lit(f"$.{name}"), F.lit("string"))
    return decoded.select("rec_id", "conversation_id", "received_at", m.alias("m")).select(
        "rec_id", "conversation_id", "received_at", text("id").alias("message_id"), text("messagetype").alias("message_type"),
        leaf_state(F.col("m")).alias("record_state"), leaf_state(_path(F.col("m"), "content")).alias("content_state"),
        text("from").alias("sender"), text("displayName").alias("display_name"),
    )


def write_subtypes(decoded: DataFrame, path: str) -> None:
    """Routes every variant to a typed table of its own: ``path/<kind>/shape=<state>``, with the supertype's keys and the
    kind's typed columns. One pass over the records parses them; the kinds are written from it."""
    rows = written(child_rows(decoded, parents=True).withColumn("node", F.call_function("to_json", F.col("node"))), "children", ["child_kind"])
    rows = rows.withColumn("node", F.call_function("parse_json", F.col("node")))
    for kind in AUTOMATA:
        subtype_table(rows, kind).drop("child_kind").write.partitionBy("shape").parquet(f"{path}/{kind}")
