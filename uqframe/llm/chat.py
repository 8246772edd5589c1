"""Chat formatting: schema fingerprints choose declarative mappings into canonical turns, a template writes them out.

A record's nested field paths, reduced to those any mapping names, are sorted and hashed. The hash selects one
``Mapping``, which says in data, not code, where roles and texts are found: a list of messages, a prompt and an answer,
an instruction with an input, or rows of one turn each. Every layout becomes ``turns array<struct<role, text>>``.
The template puts markers around each turn and breaks up its own control strings inside texts; both can be undone.
Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from uqframe.llm.common import let

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """Where one layout keeps its turns.

    kind ``messages``: ``source`` is an array path, ``role`` and ``text`` are fields of its elements.
    kind ``fields``: ``parts`` lists (role, (path, ...)); the paths of a part are joined by a blank line, an empty part is no turn.
    kind ``rows``: ``source`` groups rows, ``order`` sorts them, ``role`` and ``text`` are columns.
    """

    name: str
    kind: str
    source: str = ""
    role: str = ""
    text: str = ""
    order: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)

    def paths(self) -> set[str]:
        if self.kind == "messages":
            return {self.source, f"{self.source}.{self.role}", f"{self.source}.{self.text}"}
        if self.kind == "rows":
            return {self.source, self.order, self.role, self.text}
        return {p for _, ps in self.parts for p in ps}


_SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "prompter": "user"}

MAPPINGS = (
    Mapping("turn rows", "rows", source="conv_id", order="turn", role="role", text="text"),
    Mapping("messages", "messages", source="messages", role="role", text="content"),
    Mapping("from and value", "messages", source="conversations", role="from", text="value", aliases=_SPEAKERS),
    Mapping("prompt and completion", "fields", parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt and response", "fields", parts=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("system, question, response", "fields", parts=(("system", ("system_prompt",)), ("user", ("question",)), ("assistant", ("response",)))),
    Mapping("instruction and output", "fields", parts=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("instruction, input, output", "fields", parts=(("user", ("instruction", "input")), ("assistant", ("output",)))),
)


def vocabulary(mappings: tuple[Mapping, ...] = MAPPINGS) -> list[str]:
    """All paths that mappings name; other fields of a record don't count for its fingerprint."""
    return sorted(set().union(*(m.paths() for m in mappings)))


def by_rank(mappings: tuple[Mapping, ...]) -> list[Mapping]:
    """The order in which mappings are tried where several fit: those of more paths first, else as they are listed."""
    return sorted(mappings, key=lambda m: -len(m.paths()))


def fingerprint(paths: Column) -> Column:
    """Hash of an array of paths, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"), 256)


def fingerprint_of(mapping: Mapping) -> Column:
    return fingerprint(F.array(*[F.lit(p) for p in sorted(mapping.paths())]))


def field_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """All nested field paths of a schema; an array adds no step."""
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, prefix)
    out: list[str] = []
    if isinstance(schema, T.StructType):
        for f in schema.fields:
            at = f"{prefix}.{f.name}" if prefix else f.name
            out += [at, *field_paths(f.dataType, at)]
    return out


def json_paths(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """The known paths that a JSON text has with a value that isn't null; what isn't JSON has none."""
    v = F.try_parse_json(record)

    def present(path: str) -> Column:
        head, _, leaf = path.partition(".")
        if not leaf:
            return F.try_variant_get(v, f"$.{head}", "string").isNotNull()
        return F.exists(F.coalesce(F.try_variant_get(v, f"$.{head}", "array<map<string,string>>"), F.array().cast("array<map<string,string>>")), lambda m: F.coalesce(F.map_contains_key(m, F.lit(leaf)), F.lit(False)))

    return F.array_compact(F.array(*[F.when(present(p), F.lit(p)) for p in vocabulary(mappings)]))


def _role(role: Column, aliases: dict[str, str]) -> Column:
    r = F.coalesce(role, F.lit(""))
    for a, b in aliases.items():
        r = F.when(role == a, F.lit(b)).otherwise(r)
    return r


def _message(m: Mapping):
    value = lambda x, name: F.get(F.map_values(F.map_filter(x, lambda k, _: k == name)), 0)
    return lambda x: F.struct(_role(value(x, m.role), m.aliases).alias("role"), F.coalesce(value(x, m.text), F.lit("")).alias("text"))


def turns_of_json(record: Column, mappings: tuple[Mapping, ...] = MAPPINGS) -> Column:
    """Canonical turns of a JSON record by the mapping whose fingerprint its paths have; null for an unknown layout.

    A mapping looks at its own paths only, so a record may have fields of other layouts besides. Where several
    mappings fit, ``by_rank`` decides.
    """
    v = F.try_parse_json(record)
    present = json_paths(record, mappings)
    out = F.lit(None).cast(TURNS)
    for m in reversed(by_rank(mappings)):
        if m.kind == "messages":
            rows = F.try_variant_get(v, f"$.{m.source}", "array<map<string,string>>")
            turns = F.transform(rows, _message(m))
        elif m.kind == "fields":
            parts = []
            for role, paths in m.parts:
                values = F.filter(F.array(*[F.try_variant_get(v, f"$.{p}", "string") for p in paths]), lambda x: x != "")
                parts.append(F.when(F.size(values) > 0, F.struct(F.lit(role).alias("role"), F.array_join(values, "\n\n").alias("text"))))
            turns = F.array_compact(F.array(*parts))
        else:
            continue
        own = F.array_intersect(present, F.array(*[F.lit(p) for p in sorted(m.paths())]))
        out = F.when(fingerprint(own) == fingerprint_of(m), turns).otherwise(out)
    return out


def turns_of_rows(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Rows of one turn each, gathered by their key: key and ``turns``.

    The fingerprint of the frame's field paths selects the mapping, each mapping by its own paths; extra columns are
    ignored, also those that other mappings name. Turns stand in the
    order of the order column, ties by role and text, nulls first. Null roles and texts are empty. Rows with a null key
    are one conversation. A conversation is as large as the text it becomes, and is held by one task as that text.
    """
    have = set(field_paths(df.schema))
    named = lambda paths: hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()
    m = next((m for m in by_rank(mappings) if m.kind == "rows" and named(have & m.paths()) == named(m.paths())), None)
    if m is None:
        raise ValueError(f"no mapping of rows fits the fields {sorted(have & set(vocabulary(mappings)))}")
    own = df.select(F.col(m.source), F.struct(F.col(m.order).alias("order"), _role(F.col(m.role), m.aliases).alias("role"), F.coalesce(F.col(m.text), F.lit("")).alias("text")).alias("turn_"))
    return own.groupBy(m.source).agg(F.sort_array(F.collect_list("turn_")).alias("t")).select(m.source, F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


@dataclass(frozen=True)
class Template:
    """Markers around a turn by role; ``other`` also writes the role. The text of ``loss_role`` is under the loss mask."""

    markers: tuple[tuple[str, str, str], ...] = (("system", "<<SYS>>", "<</SYS>>"), ("user", "[INST] ", " [/INST]"), ("assistant", "<s>", "</s>"))
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[END]")
    loss_role: str = "assistant"

    def control(self) -> list[str]:
        return sorted({x.strip() for _, a, b in self.markers for x in (a, b)} | set(self.other))

    def pattern(self, marks: str) -> str:
        """Each control string with ``marks`` (a group of backslashes) after its first character."""
        heads: dict[str, list[str]] = {}
        for c in self.control():
            heads.setdefault(c[0], []).append(c[1:])
        quote = lambda s: "".join("\\" + x if x in "[]()<>/\\.*+?{}^$|" and x not in "</>" else x for x in s)
        return "|".join(f"(?<={quote(h)})({marks})(?={'|'.join(map(quote, sorted(rest)))})" for h, rest in sorted(heads.items()))


TEMPLATE = Template()


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    r"""One more backslash after the first character of a control string, or of one with backslashes there already."""
    return F.regexp_replace(text, template.pattern(r"\\*+"), "$0\\\\")


def unescape(text: Column, template: Template = TEMPLATE) -> Column:
    r"""Takes one backslash away where ``escape`` has put one."""
    pattern = template.pattern(r"\\*+").replace(r"(\\*+)", r"\\(\\*+)")
    groups = pattern.count(r"(\\*+)")
    return F.regexp_replace(text, pattern, "".join(f"${i + 1}" for i in range(groups)))


def format_turns(turns: Column, template: Template = TEMPLATE) -> Column:
    """Struct of ``formatted`` (text) and ``loss_spans`` (array of start and end in code points of it, end excluded)."""
    esc = lambda x: escape(x, template)

    def pieces(t: Column) -> Column:
        a, b, c = template.other
        out = F.struct(F.concat(F.lit(a), esc(t["role"]), F.lit(b)).alias("before"), esc(t["text"]).alias("body"), F.lit(c).alias("after"), (t["role"] == template.loss_role).alias("loss"))
        for role, before, after in template.markers:
            out = F.when(t["role"] == role, F.struct(F.lit(before).alias("before"), esc(t["text"]).alias("body"), F.lit(after).alias("after"), F.lit(role == template.loss_role).alias("loss"))).otherwise(out)
        return out

    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["before"])
        end = start + F.length(p["body"])
        spans = F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct((end + F.length(p["after"])).alias("at"), spans.alias("spans"))

    return let(F.transform(turns, pieces), lambda ps: F.struct(F.array_join(F.transform(ps, lambda p: F.concat(p["before"], p["body"], p["after"])), "").alias("formatted"), F.aggregate(ps, empty, step, lambda a: a["spans"]).alias("loss_spans")))


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns of a formatted text, read back: cut behind each closing marker, tell the role by the opening one."""
    quote = lambda s: "".join("\\" + x if x in "[](){}.*+?^$|\\" else x for x in s)
    a, b, c = template.other
    ends = [*(m[2] for m in template.markers), c]
    cuts = f"(?<={'|'.join(map(quote, ends))})"  # texts hold no closing marker, so every one ends a turn
    une = lambda x: unescape(x, template)

    def turn(s: Column) -> Column:
        body = F.substring_index(s, b, 1)
        out = F.struct(une(F.substr(body, F.lit(len(a) + 1))).alias("role"), une(F.substr(s, F.length(body) + len(b) + 1, F.length(s) - F.length(body) - len(b) - len(c))).alias("text"))
        for role, before, after in template.markers:
            out = F.when(s.startswith(before), F.struct(F.lit(role).alias("role"), une(F.substr(s, F.lit(len(before) + 1), F.length(s) - len(before) - len(after))).alias("text"))).otherwise(out)
        return out

    return F.transform(F.filter(F.split(formatted, cuts), lambda s: s != ""), turn)


def loss_texts(formatted: Column, loss_spans: Column, template: Template = TEMPLATE) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    return F.transform(loss_spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), template))


def format_rows(df: DataFrame, template: Template = TEMPLATE, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Conversations given as rows of turns: their key, ``formatted`` and ``loss_spans``."""
    turns = turns_of_rows(df, mappings)
    key = turns.columns[0]
    return turns.select(key, format_turns(F.col("turns"), template).alias("f")).select(key, "f.formatted", "f.loss_spans")


def format_json(df: DataFrame, record: str, template: Template = TEMPLATE, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``df`` with ``schema_id`` (the fingerprint), ``formatted`` and ``loss_spans``; both are null for an unknown layout."""
    names = [c for c in df.columns if c not in ("schema_id", "formatted", "loss_spans")]
    f = format_turns(turns_of_json(F.col(record), mappings), template)
    return df.select(*names, fingerprint(json_paths(F.col(record), mappings)).alias("schema_id"), f.alias("__f")).select(*names, "schema_id", F.when(F.col("__f.formatted").isNotNull(), F.col("__f.formatted")).alias("formatted"), "__f.loss_spans")
