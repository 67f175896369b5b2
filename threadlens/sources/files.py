"""Files as they come: pages in doubtful encodings, attachments, walks with inferred sources, and sinks by document."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Encodings that are tried, most bytes and characters of an attachment, endings that are read.
ENCODINGS = ("utf-8", "cp949", "euc-kr", "utf-16-le", "utf-16-be", "latin-1")
MOST_BYTES, MOST_CHARS = 8 << 20, 50_000
_META = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_-]+)|\bcharset\s*=\s*([A-Za-z0-9_-]+)""", re.I)
_HANGUL, _ODD = re.compile("[가-힣]"), re.compile("[�\u0080-\u009f]")


def likeness(text: str) -> float:
    """How much a text looks as if it was decoded right: Hangul and plain letters speak for it, replacement and control characters against it."""
    if not text:
        return 0.0
    plain = sum(c.isascii() and (c.isprintable() or c in "\r\n\t") for c in text)
    return (2 * len(_HANGUL.findall(text)) + plain - 8 * len(_ODD.findall(text))) / len(text)


def decode(raw: bytes) -> tuple[str, str]:
    """The text of a page and the encoding it was read in: of the declared one and ENCODINGS that which looks best, the first among equals."""
    found = _META.search(raw[:4096])
    declared = (found[1] or found[2]).decode("ascii").lower() if found else ""
    best = ("", "", float("-inf"))
    for name in dict.fromkeys([x for x in (declared, *ENCODINGS) if x]):
        try:
            text = raw.decode(name, "replace")
        except LookupError:
            continue
        if (score := likeness(text)) > best[2]:
            best = (text, name, score)
    return best[0], best[1]


def repaired_name(name: str) -> str:
    """A name that was read in the wrong encoding, read again: UTF-8 or CP949 bytes taken for Latin-1, where that has more Hangul."""
    for right in ("utf-8", "cp949"):
        try:
            again = name.encode("latin-1").decode(right)
        except UnicodeError:
            continue
        if len(_HANGUL.findall(again)) > len(_HANGUL.findall(name)):
            return again
    return name


def attachment_text(name: str, raw: bytes | None) -> tuple[str, str]:
    """The text of an attachment and a note where there is none: plain files, pages, and documents that are archives of XML."""
    ending = name.lower().rpartition(".")[2]
    if raw is None:
        return "", "missing"
    if len(raw) > MOST_BYTES:
        return "", "too_large"
    try:
        if ending in ("txt", "md", "csv"):
            text = decode(raw)[0]
        elif ending in ("html", "htm"):
            text = re.sub(r"<[^>]+>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", decode(raw)[0]))
        elif ending in ("docx", "hwpx"):
            with zipfile.ZipFile(io.BytesIO(raw)) as z:
                inner = [n for n in z.namelist() if re.search(r"^word/document\.xml$|^Contents/section\d+\.xml$", n)]
                text = "\n".join(re.sub(r"<[^>]+>", "", re.sub(r"</(w:p|hp:p)>", "\n", z.read(n).decode("utf-8", "replace"))) for n in sorted(inner))
        else:
            return "", "unsupported_ext"
    except (zipfile.BadZipFile, KeyError, ValueError) as e:
        return "", f"failed:{type(e).__name__}"
    text = re.sub(r"[ \t]+", " ", text).strip()
    return text[:MOST_CHARS], "" if text else "empty"


def decoded(content: Column) -> Column:
    """A struct of text and encoding of a column of bytes; null bytes give an empty text."""

    @F.pandas_udf("text string, encoding string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for raws in batches:
            yield pd.DataFrame([decode(bytes(x)) if x is not None else ("", "") for x in raws], columns=["text", "encoding"])

    return read(content)


def attachment_texts(name: Column, content: Column) -> Column:
    """A struct of text, chars and note of attachments."""

    @F.pandas_udf("text string, chars long, note string")
    def read(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, raws in batches:
            found = [attachment_text(n or "", None if x is None else bytes(x)) for n, x in zip(names, raws)]
            yield pd.DataFrame([(t, len(t), note) for t, note in found], columns=["text", "chars", "note"])

    return read(name, content)


def readable_share(lines: DataFrame, content_col: str = "content", first: int = 50) -> DataFrame:
    """Of files' first lines the share that parses as JSON in UTF-8 and in CP949, and the encoding to take: UTF-8 from 0.8 on, else the better one."""
    out = lines
    for name, codec in (("utf8", "UTF-8"), ("cp949", "x-windows-949")):
        heads = F.slice(F.filter(F.split(F.decode(F.col(content_col), codec) if codec == "UTF-8" else F.decode(F.col(content_col), F.lit(codec)), r"\r?\n"), lambda x: F.trim(x) != ""), 1, first)
        fine = F.size(F.filter(heads, lambda x: F.try_parse_json(x).isNotNull() & ~x.contains("�")))
        out = out.withColumn(f"{name}_share", fine / F.greatest(F.size(heads), F.lit(1)))
    return out.withColumn("encoding", F.when((F.col("utf8_share") >= 0.8) | (F.col("utf8_share") >= F.col("cp949_share")), "utf-8").otherwise("cp949"))


def with_extracted(attachments: DataFrame, texts: DataFrame) -> DataFrame:
    """`attachments(doc, name)` with `text` from `texts(base, place, text)` by the name without its ending, the file of the first place winning."""
    best = texts.groupBy("base").agg(F.min_by("text", "place").alias("text"))
    return attachments.withColumn("base", F.regexp_replace("name", r"\.[^.]*$", "")).join(best, "base", "left").drop("base")


def write_by_document(df: DataFrame, path: str, source: str, index: list[str]) -> None:
    """JSON lines below a folder for each source, and an index of the named columns beside them."""
    df.write.mode("overwrite").partitionBy(source).json(f"{path}/documents")
    df.select(source, *index).write.mode("overwrite").json(f"{path}/_index")


def rewritten(lines: DataFrame, patch: Column) -> DataFrame:
    """`lines(value)` with `patch`, an expression over the parsed JSON `v` and the line, where the line parses; others pass as they are. On batches and streams."""
    return lines.withColumn("v", F.try_parse_json("value")).select(F.when(F.col("v").isNull(), F.col("value")).otherwise(patch).alias("value"))


def json_array(df: DataFrame, order: list[str]) -> Column:
    """All rows of a small table as one JSON array, in order."""
    return F.to_json(F.array_sort(F.collect_list(F.struct(*order, *(c for c in df.columns if c not in order)))))
