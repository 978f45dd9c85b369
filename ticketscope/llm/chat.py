"""Chat formatting: a declarative template turns the rows of a conversation into one training text.

A finite-state machine over the roles checks the turn order. Every turn becomes three segments: its opening mark, its
text and its closing mark; a segment carries a loss flag, set for the texts of the template's loss roles. Marks begin
with `<|`; inside texts and roles one backslash goes between the two characters, and one more where some already
stand there, so no text can forge a mark and `unescaped` gives back exactly what was written.

Rows of a conversation are ordered by turn, then role, then text, nulls first; repeated rows are repeated turns. A null
text or role is an empty one; rows without a conversation id form a conversation of their own. A conversation whose
roles the machine refuses is formatted like any other, with `valid` false. An empty table gives an empty result, and
columns besides the four named are not read. The text of a conversation is one value, so it must fit one row.

Only DataFrame functions run here.
"""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, roles whose texts count for the loss, and the machine over roles.

    `moves` maps a state to the role it may read and the state that follows; `ends` are the accepting states.
    """

    opening: str = "<|turn:"
    named: str = "|>\n"
    closing: str = "<|end|>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "ready",
        ("start", "user"): "asked",
        ("ready", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    })
    ends: tuple[str, ...] = ("answered",)


def escaped(text: Column) -> Column:
    """The text with a backslash put into every `<|` and `|>`, after any backslashes that already part the two."""
    opened = F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")
    return F.regexp_replace(opened, r"\|(\\*)>", r"|\\$1>")


def unescaped(text: Column) -> Column:
    """Undoes `escaped`."""
    closed = F.regexp_replace(text, r"\|\\(\\*)>", r"|$1>")
    return F.regexp_replace(closed, r"<\\(\\*)\|", r"<$1|")


def accepted(roles: Column, template: Template) -> Column:
    """Whether the machine ends in an accepting state after reading all roles; an empty list is refused."""
    moves = F.create_map(*(F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)))
    step = lambda state, role: F.coalesce(F.try_element_at(moves, F.concat(state, F.lit("\n"), role)), F.lit(""))
    return F.aggregate(roles, F.lit(template.start), step).isin(*template.ends)


def conversations_of(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its key and its ordered turns as an array of (role, text)."""
    empty = F.lit("")
    row = F.struct(turns[turn].alias("turn"), F.coalesce(turns[role].cast("string"), empty).alias("role"), F.coalesce(turns[text].cast("string"), empty).alias("text"))
    return turns.groupBy(turns[conv].alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))


def formatted(turns: DataFrame, template: Template = Template(), **columns: str) -> DataFrame:
    """(conv_id, valid, segments, formatted): the segments in order with their loss flags, and the text they join to."""
    marks = lambda t: F.array(
        F.struct(F.concat(F.lit(template.opening), escaped(t.role), F.lit(template.named)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escaped(t.text).alias("text"), t.role.isin(*template.loss_roles).alias("loss")),
        F.struct(F.lit(template.closing).alias("text"), F.lit(False).alias("loss")),
    )
    whole = conversations_of(turns, **columns)
    built = whole.select(
        "conv_id",
        accepted(F.transform("turns", lambda t: t.role), template).alias("valid"),
        F.flatten(F.transform("turns", marks)).alias("segments"),
    )
    return built.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s.text), ""))


def turns_of(text: Column, template: Template = Template()) -> Column:
    """The turns read back from a formatted text, as an array of (role, text)."""
    parts = F.split(text, r"\Q" + template.closing + r"\E")
    bodies = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    after = len(template.opening)

    def parsed(part: Column) -> Column:
        mark = F.instr(part, template.named)
        return F.struct(
            unescaped(F.substring(part, F.lit(after + 1), mark - F.lit(after + 1))).alias("role"),
            unescaped(F.substring(part, mark + F.lit(len(template.named)), F.char_length(part))).alias("text"),
        )

    return F.transform(bodies, parsed)


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as it was written, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescaped(s.text)), "")


def digest(formatted_rows: DataFrame, template: Template = Template()) -> DataFrame:
    """Counts and digests read back from the formatted text and its loss mask."""
    read = formatted_rows.withColumns({"back": turns_of(F.col("formatted"), template), "under": loss_text(F.col("segments"))})
    lines = F.array_join(F.transform("back", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("under").cast("long").alias("loss_chars"),
        F.sha2(F.col("under"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )
