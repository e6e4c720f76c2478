"""Text of documents and message trees: signatures, text decoding, XML, archives with budgets, content trees."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Entries, depth and expanded bytes of an archive; nodes and depth of a content tree; characters of a text.
ENTRIES, DEPTH, EXPANDED, NODES, TREE_DEPTH, CHARS = 64, 2, 32 << 20, 1000, 8, 200_000
_BLOCKS = {"p", "br", "tr", "div", "li", "h1", "h2", "h3", "text:p", "w:p", "w:br", "a:p", "a:br"}


def file_kind(content: Column) -> Column:
    """Kind of a file by its first bytes; ``text`` if it has no control characters, else ``unknown``."""
    head = F.hex(F.substring(content, 1, 16))
    text = F.decode(content, "UTF-8")
    out = F.when(F.startswith(head, F.lit("504B0304")), "zip").when(F.startswith(head, F.lit("25504446")), "pdf")
    out = out.when(F.startswith(head, F.lit("89504E47")) | F.startswith(head, F.lit("FFD8FF")) | F.startswith(head, F.lit("47494638")), "image")
    out = out.when(F.startswith(head, F.lit("1A45DFA3")) | (F.substring(head, 9, 8) == "66747970") | F.startswith(head, F.lit("4F676753")), "av")
    bom = F.startswith(head, F.lit("FFFE")) | F.startswith(head, F.lit("FEFF"))
    valid = F.is_valid_utf8(content.cast("string"))
    out = out.when(valid & text.rlike(r"(?is)^\s*(?:<\?xml.*?\?>\s*)?<svg[\s>]"), "svg").when(valid & text.rlike(r"(?s)^\s*<\?xml"), "xml")
    return out.when(bom | (valid & ~text.rlike(r"[\x00-\x08\x0E-\x1F]")), "text").otherwise("unknown")


def decode_text(content: Column) -> Column:
    """Text of a file by its byte-order mark, UTF-8 without one; null if malformed or with control characters."""
    head = F.hex(F.substring(content, 1, 3))
    text = F.when(F.startswith(head, F.lit("FFFE")), F.decode(F.substring(content, F.lit(3), F.length(content)), "UTF-16LE"))
    text = text.when(F.startswith(head, F.lit("FEFF")), F.decode(F.substring(content, F.lit(3), F.length(content)), "UTF-16BE"))
    plain = F.regexp_replace(F.decode(content, "UTF-8"), "^﻿", "")
    text = text.when(F.is_valid_utf8(content.cast("string")), plain)
    return F.when(~text.rlike(r"[\x00-\x08\x0B\x0E-\x1F]"), text)


def xml_text(data: str) -> tuple[str, list[str]]:
    """Text of an XML document with block elements as lines, and issues: a doctype is refused, outside targets are named."""
    import xml.sax

    if "<!DOCTYPE" in data.upper():
        return "", ["document failed: doctype"]
    out: list[str] = []
    issues: list[str] = []

    class Reader(xml.sax.ContentHandler):
        def startElement(self, name, attrs):  # noqa: N802
            if attrs.get("TargetMode") == "External":
                issues.append("external content")

        def endElement(self, name):  # noqa: N802
            if name.lower() in _BLOCKS:
                out.append("\n")

        def characters(self, content):
            out.append(content)

    try:
        xml.sax.parseString(data.encode(), Reader())
    except xml.sax.SAXException:
        return "", ["document failed: malformed"]
    return "".join(out), list(dict.fromkeys(issues))


def archive_texts(data: bytes, depth: int = 0, budget: list[int] | None = None) -> tuple[list[str], list[str]]:
    """Texts of an archive's XML and text entries and of archives inside it, within the budgets, and issues."""
    budget = budget if budget is not None else [ENTRIES, EXPANDED]
    texts: list[str] = []
    issues: list[str] = []
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for entry in archive.infolist():
                if entry.is_dir():
                    continue
                if entry.flag_bits & 1:
                    issues.append("unsupported: encrypted")
                    continue
                budget[0] -= 1
                budget[1] -= entry.file_size
                if budget[0] < 0 or budget[1] < 0:
                    issues.append("archive limit exceeds")
                    break
                body = archive.read(entry)
                if body[:4] == b"PK\x03\x04":
                    inner, more = archive_texts(body, depth + 1, budget) if depth + 1 < DEPTH else ([], ["archive limit: depth"])
                    texts += inner
                    issues += more
                elif entry.filename.endswith((".xml", ".rels")):
                    text, more = xml_text(body.decode("utf-8", "replace"))
                    texts.append(text)
                    issues += more
                elif entry.filename.endswith((".txt", ".md", ".csv")):
                    texts.append(body.decode("utf-8", "replace"))
    except (zipfile.BadZipFile, NotImplementedError):
        issues.append("document failed: archive")
    return texts, list(dict.fromkeys(issues))


def extract(files: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``files`` (content binary) with kind, text and issues; unknown and media files give no text but an issue."""
    schema = files.select(*keep).schema.add("kind", "string").add("text", "string")
    from pyspark.sql.types import ArrayType, StringType

    schema = schema.add("issues", ArrayType(StringType()))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            kinds, plain, content = (part.column(len(keep) + i).to_pylist() for i in range(3))
            out = []
            for kind, text, data in zip(kinds, plain, content, strict=True):
                if kind in ("zip",):
                    texts, issues = archive_texts(data)
                    out.append(("\n".join(texts), issues))
                elif kind in ("xml", "svg"):
                    out.append(xml_text(text or ""))
                elif kind == "text":
                    out.append((text or "", [] if text is not None else ["document failed: text"]))
                else:
                    out.append(("", [f"unsupported content: {kind}"]))
            cut = [(t[:CHARS], i + ["text limit exceeds"] * (len(t) > CHARS)) for t, i in out]
            yield pa.RecordBatch.from_arrays(
                [*part.columns[: len(keep)], pa.array(kinds, pa.string()), pa.array([t for t, _ in cut], pa.string()), pa.array([i for _, i in cut], pa.list_(pa.string()))],
                names=[*keep, "kind", "text", "issues"],
            )

    source = files.select(*keep, file_kind(F.col("content")).alias("k"), decode_text(F.col("content")).alias("t"), F.col("content").alias("c"))
    return source.mapInArrow(run, schema)


def html_text(html: Column) -> Column:
    """Text of a web page: scripts and styles dropped, block ends as lines, tags gone, common entities decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|br|li|tr|h[1-6])\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    for entity in ("&lt;", "&gt;", "&quot;", "&#39;", "&nbsp;", "&amp;"):
        t = F.replace(t, F.lit(entity), F.lit(unescape(entity).replace("\xa0", " ")))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def content_tree(message: str) -> tuple[str, list[str], list[str]]:
    """(text, asset addresses, issues) of a message tree in JSON: text fields in order, assets by address, nodes and depth limited."""
    texts: list[str] = []
    assets: dict[str, None] = {}
    issues: list[str] = []
    seen = 0
    stack = [(json.loads(message), 0)]
    while stack:
        node, depth = stack.pop()
        seen += 1
        if seen > NODES or depth > TREE_DEPTH:
            issues.append("content limit exceeds")
            break
        if isinstance(node, list):
            stack.extend((x, depth) for x in reversed(node))
        elif isinstance(node, dict):
            texts += [node[k] for k in ("content", "title", "name", "description", "value", "label", "text", "question", "footer") if isinstance(node.get(k), str) and node[k]]
            if isinstance(node.get("url"), str):
                assets[node["url"]] = None
            stack.extend((node[k], depth + 1) for k in reversed(("attachments", "embeds", "fields", "stickers", "poll", "answers", "snapshots", "components", "accessory", "items", "media", "image", "thumbnail")) if node.get(k))
    return "\n".join(texts), list(assets), issues


def flatten_trees(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``rows`` (tree: JSON) with text, assets and issues; a null or malformed tree is an issue."""
    from pyspark.sql.types import ArrayType, StringType

    strings = ArrayType(StringType())

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for tree in part.column(len(keep)).to_pylist():
                try:
                    out.append(content_tree(tree))
                except (TypeError, ValueError):
                    out.append(("", [], ["content failed"]))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[: len(keep)], pa.array([o[0] for o in out], pa.string()), *(pa.array([o[i] for o in out], pa.list_(pa.string())) for i in (1, 2))],
                names=[*keep, "text", "assets", "issues"],
            )

    schema = rows.select(*keep).schema.add("text", "string").add("assets", strings).add("issues", strings)
    return rows.select(*keep, F.col("tree").alias("__tree")).mapInArrow(run, schema)


def read_files(spark, path: str, most: int = 32 << 20) -> DataFrame:
    """(path, length, content) of files of ``most`` bytes or fewer; larger ones are never read, as the filter reaches the listing."""
    files = spark.read.format("binaryFile").load(path)
    return files.where(F.col("length") <= most).select("path", "length", "content")
