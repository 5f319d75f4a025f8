"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

Only DataFrame functions are used. A formatted conversation is one string, so its turns meet in one row; conversations are
bounded by what a model can read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, WRONG = "start", "wrong"


@dataclass(frozen=True)
class Template:
    """How turns are marked, which roles a model learns from, and which role may follow which.

    The three marks are control strings. Inside texts and roles a backslash is put after their first character, and
    backslashes are doubled, so that a control string in the output is always a mark.
    """

    open: str = "<turn:"
    head: str = ":turn>"
    close: str = "</turn>"
    learned: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.open, self.head, self.close


TEMPLATE = Template()


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|/<>:" else c for c in s)


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in template.marks:
        out = F.replace(out, F.lit(mark), F.lit(f"{mark[0]}\\{mark[1:]}"))
    return out


def unescape(text: Column, template: Template = TEMPLATE) -> Column:
    rest = "|".join(_quoted(mark[1:]) for mark in template.marks)
    return F.regexp_replace(text, rf"\\(\\|{rest})", "$1")


def format_conversations(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         template: Template = TEMPLATE) -> DataFrame:
    """One row for each conversation.

    conv_id; segments (struct: piece, begin in code points, loss) in order, whose pieces joined are ``formatted``; valid
    (whether the roles are in order and the last is final); wrong_turn (number of the first turn that is out of order, from 0).
    Turns are ordered by turn, then role, then text (nulls first); repeated rows are turns of their own. Null texts and roles
    count as empty; a null conv_id is a conversation. Conversations out of order are formatted all the same.
    """
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    grouped = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("turns"))
    moves = F.create_map(*[F.lit(x) for state, roles in template.follows.items() for r in roles for x in (f"{state}\n{r}", r)])
    walk = F.aggregate(
        "turns", F.struct(F.lit(START).alias("state"), F.lit(-1).cast("long").alias("wrong"), F.lit(0).cast("long").alias("n")),
        lambda acc, t: F.struct(
            F.when(acc["state"] == WRONG, F.lit(WRONG))
            .otherwise(F.coalesce(moves[F.concat(acc["state"], F.lit("\n"), t["role"])], F.lit(WRONG))).alias("state"),
            F.when((acc["wrong"] < 0) & moves[F.concat(acc["state"], F.lit("\n"), t["role"])].isNull(), acc["n"]).otherwise(acc["wrong"]).alias("wrong"),
            (acc["n"] + 1).alias("n")))
    learned = [F.lit(r) for r in template.learned]
    pieces = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit(template.open), escape(t["role"], template), F.lit(template.head)).alias("piece"), F.lit(False).alias("loss")),
        F.struct(escape(t["text"], template).alias("piece"), t["role"].isin(*learned).alias("loss")),
        F.struct(F.lit(template.close).alias("piece"), F.lit(False).alias("loss")))))
    return (grouped.withColumn("_walk", walk).withColumn("segments", pieces)
            .select("conv_id", "segments", F.array_join(F.col("segments.piece"), "").alias("formatted"),
                    F.col("_walk.state").isin(*template.final).alias("valid"),
                    F.when(F.col("_walk.wrong") >= 0, F.col("_walk.wrong")).alias("wrong_turn")))


def read_back(formatted: DataFrame, *, column: str = "formatted", template: Template = TEMPLATE) -> DataFrame:
    """All columns, and ``turns``: role and text of each turn, parsed from the formatted string alone."""
    parts = F.split(F.col(column), _quoted(template.close), -1)
    own = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    size, head = len(template.open), len(template.head)

    def turn(part):
        body = F.substr(part, F.lit(size + 1))
        at = F.position(F.lit(template.head), body)
        return F.struct(unescape(F.substr(body, F.lit(1), at - 1), template).alias("role"),
                        unescape(F.substr(body, at + head), template).alias("text"))

    return formatted.withColumn("turns", F.transform(own, turn))
