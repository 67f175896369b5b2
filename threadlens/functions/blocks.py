"""Threads cut into blocks that know their place in the text, and into the turns of a telephone view, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlens.functions.text import SPACE, trim_all

#: White space within a line.
_GAP = f"[{SPACE[1:-1]}&&[^\\n]]"
#: Marks of a speaker, and the forms of a clock and of a date at the head of a message.
_SPEAKER = rf"(S|R|sender|receiver|발신|수신){_GAP}*+:"
_CLOCK = rf"(?:오전|오후)?{_GAP}*\d{{1,2}}:\d{{2}}"
_DATE = r"\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2}"
_HEADS = (rf"\[{_GAP}*{_CLOCK}{_GAP}*\]", rf"{_DATE}{_GAP}+{_CLOCK}", r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}", rf"{_CLOCK}{_GAP}+.{{1,40}}:")
_LABEL = rf"^(?:(?:{_DATE}{_GAP}+)?{_CLOCK}{_GAP}+|\[{_GAP}*{_CLOCK}{_GAP}*\]{_GAP}*)(.{{1,40}}?):"
_OPENS = rf"(?i)\n(?={_GAP}*+(?:\n|\z|{_SPEAKER}|{'|'.join(_HEADS)}))"
BLOCK = "struct<start:int,end:int,speaker:string,label:string,text:string>"


def unix_lines(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n"))


def block_ranges(text: Column, default_who: str | None = None, most: int = 200) -> Column:
    """The first `most` blocks of a thread, an array of structs of start, end, speaker, label and text.

    A line with a speaker's mark or a message's head opens a block, a blank line closes one. `start` and `end` (exclusive) count code points from 0 in the text with line ends as LF; that part of it, without the space at the ends of its lines and before it, is the block's text.
    The speaker is S or R by the opening line's mark, else U; the label is the name in the opening line's head, else null. With `default_who` every line is a block, and one without a mark is that speaker's. Null, empty and blank texts have no blocks.

    The text is cut where a line opens a block or is blank, so all that is between two parts is one line end, and one pass over the parts carries the place in the text. Nothing is shuffled.
    """
    parts = F.split(unix_lines(text), "\n" if default_who else _OPENS, -1)

    def step(held: Column, part: Column) -> Column:
        words = F.regexp_replace(F.regexp_replace(part, rf"(?<!{_GAP}){_GAP}++(?=\n|\z)", ""), rf"^{SPACE}++", "")
        mark = F.lower(F.regexp_extract(words, f"(?i)^{_SPEAKER}", 1))
        block = F.struct(
            (held["at"] + F.length(F.regexp_extract(part, rf"^{_GAP}*+\n", 0))).alias("start"),
            (held["at"] + F.length(part)).alias("end"),
            F.when(mark.isin("r", "receiver", "수신"), "R").when(mark != "", "S").otherwise(default_who or "U").alias("speaker"),
            F.nullif(trim_all(F.regexp_extract(words, _LABEL, 1)), F.lit("")).alias("label"),
            words.alias("text"),
        )
        taken = (F.size(held["blocks"]) < most) & (words != "")
        # past the last block nothing is copied any more, so a long thread costs one step for each part
        return F.struct((held["at"] + F.length(part) + 1).alias("at"), F.when(taken, F.concat(held["blocks"], F.array(block))).otherwise(held["blocks"]).alias("blocks"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{BLOCK}>").alias("blocks"))
    return F.aggregate(parts, start, step, lambda held: held["blocks"])


def phone_turns(text: Column, most: int = 300) -> Column:
    """The first `most` turns of a thread as a telephone shows it, an array of structs of who and text.

    A line with S: or R: begins a turn, others go on with it, blank lines notwithstanding; what stands before the first mark is S's. Turns without text are left out.
    """
    lines = F.filter(F.transform(F.split(unix_lines(text), "\n", -1), trim_all), lambda x: x != "")
    mark = rf"(?i)^([sr]){_GAP}*+:{SPACE}*+"
    turns = F.transform(F.split(F.array_join(lines, "\n"), rf"(?i)\n(?=[sr]{_GAP}*+:)", -1), lambda x: F.struct(
        F.when(F.lower(F.regexp_extract(x, mark, 1)) == "r", "R").otherwise("S").alias("who"), F.regexp_replace(x, mark, "").alias("text")))
    return F.slice(F.filter(turns, lambda x: x["text"] != ""), 1, most)


def turns_text(turns: Column, n: int) -> Column:
    """The first `n` turns written as lines with marks."""
    return F.array_join(F.transform(F.slice(turns, 1, max(n, 0)), lambda x: F.concat_ws(": ", x["who"], x["text"])), "\n")
