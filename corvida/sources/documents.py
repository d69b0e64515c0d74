"""Office documents as (filename, part_index, text) rows.

Text and Markdown are whole-text scans. DOCX is read with the standard library inside executors: paragraphs in order, and a marker
line for every picture, whose bytes come out as rows of their own. PDF and MSG need ``pypdf`` and ``extract_msg`` on the executors; without them such files
come out with an error and no text.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvida.functions import text as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: File endings of picture types; others are saved as .png.
_ENDINGS = {"image/png": ".png", "image/jpeg": ".jpg", "image/gif": ".gif", "image/bmp": ".bmp", "image/webp": ".webp"}


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, filename, supported, length) of the files of a folder."""
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    return files.withColumn("filename", T.basename(F.col("path"))).withColumn("supported", T.supported(F.col("filename")))


def _part(target: str) -> str:
    """A relationship's target as a name in the archive: from the archive's root, or from the document's folder."""
    steps: list[str] = []
    for step in (target.lstrip("/") if target.startswith("/") else f"word/{target}").split("/"):
        steps = steps[:-1] if step == ".." else [*steps, step] if step != "." else steps
    return "/".join(steps)


def content_types(z: zipfile.ZipFile) -> tuple[dict[str, str], dict[str, str]]:
    """Types of parts, and types of file endings for the parts that have none of their own."""
    if "[Content_Types].xml" not in z.namelist():
        return {}, {}
    entries = list(ET.fromstring(z.read("[Content_Types].xml")))
    parts = {e.get("PartName", "").lstrip("/"): e.get("ContentType", "") for e in entries if e.get("PartName")}
    return parts, {e.get("Extension", "").lower(): e.get("ContentType", "") for e in entries if e.get("Extension")}


def read_docx(blob: bytes) -> tuple[str, list[tuple[str, bytes]]]:
    """(text with markers, [(image name, bytes)]) in document order; a document without any text is an error."""
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        names, (own, by_ending) = set(z.namelist()), content_types(z)
        targets = {}
        if "word/_rels/document.xml.rels" in names:
            targets = {r.get("Id"): _part(r.get("Target") or "") for r in ET.fromstring(z.read("word/_rels/document.xml.rels"))}
        paragraphs, images = [], []
        for p in ET.fromstring(z.read("word/document.xml")).iter(f"{_W}p"):
            marks = {f"{_W}t": lambda n: n.text or "", f"{_W}tab": lambda n: "\t", f"{_W}br": lambda n: "\n"}
            text = "".join(marks[n.tag](n) for n in p.iter() if n.tag in marks).strip()
            paragraphs += [text] if text else []
            for node in p.iter():
                part = targets.get(node.get(f"{_R}embed") or (node.get(f"{_R}id") if node.tag.endswith("}imagedata") else None))
                if part in names:
                    kind = own.get(part) or by_ending.get(part.rpartition(".")[2].lower(), "")
                    images.append((f"img_{len(images) + 1:03d}{_ENDINGS.get(kind, '.png')}", z.read(part)))
                    paragraphs.append(f"[Рисунок {len(images)}: {images[-1][0]}]")
        if not paragraphs:
            raise ValueError("no text in the document")
        return "\n".join(paragraphs), images


def _pdf(blob: bytes) -> list[str]:
    import pypdf

    return [page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(blob)).pages]


def _message(blob: bytes) -> list[str]:
    import extract_msg

    m = extract_msg.openMsg(blob)
    head = [f"{label}: {value}" for label, value in (("Subject", m.subject), ("From", m.sender), ("Date", m.date)) if value and str(value).strip()]
    text = "\n".join([*head, *(["\n" + m.body] if m.body and m.body.strip() else [])])
    if not text:
        raise ValueError("empty message")
    return [text]


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """filename, part_index, text, error, images (name, content) of the supported files of a folder."""
    files = spark.read.format("binaryFile").load(folder).withColumn("filename", T.basename(F.col("path")))
    files = files.where(T.supported(F.col("filename"))).select("filename", T.suffix(F.col("filename")).alias("suffix"), "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            rows = []
            for name, suffix, blob in x.itertuples(index=False):
                try:
                    if suffix == ".docx":
                        text, images = read_docx(blob)
                        rows.append((name, 0, text, None, [{"name": n, "content": b} for n, b in images]))
                    else:
                        parts = _pdf(blob) if suffix == ".pdf" else _message(blob) if suffix == ".msg" else [blob.decode("utf-8", "replace")]
                        rows += [(name, i, text, None, []) for i, text in enumerate(parts)]
                except Exception as e:  # one broken file must not end the batch: it is reported in its row
                    rows.append((name, 0, None, f"{type(e).__name__}: {e}", []))
            yield pd.DataFrame(rows, columns=["filename", "part_index", "text", "error", "images"])

    return files.mapInPandas(run, "filename string, part_index int, text string, error string, images array<struct<name:string,content:binary>>")


def write_images(parsed: DataFrame, folder: str) -> DataFrame:
    """Write the pictures of ``read_documents`` below ``folder``, as <stem>_images/<name>; (filename, n_images) of the files that have any.

    ``folder`` is a path or URI in a store that all executors reach; every executor writes its own files' pictures.
    """
    rows = parsed.where(F.size("images") > 0).select("filename", T.stem(F.col("filename")).alias("stem"), "images")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for x in frames:
            for stem, images in zip(x["stem"], x["images"]):
                store.create_dir(f"{base}/{stem}_images", recursive=True)
                for image in images:
                    with store.open_output_stream(f"{base}/{stem}_images/{image['name']}") as out:
                        out.write(image["content"])
            yield pd.DataFrame({"filename": x["filename"], "n_images": x["images"].map(len)})

    return rows.mapInPandas(run, "filename string, n_images int")


def preview_text(blocks: DataFrame, *keys: str) -> DataFrame:
    """(keys, preview) of (keys, pos, text, images): blocks in order, each with its pictures' markers, numbered through, and a blank line."""
    n = F.coalesce(F.size("images"), F.lit(0))
    order = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    rows = blocks.withColumn("before", F.coalesce(F.sum(F.when(n > 0, n).otherwise(0)).over(order), F.lit(0)))

    def marker(image, i):
        number = F.col("before") + i + 1
        return F.concat(F.lit("[Рисунок "), number, F.lit(": img_"), F.lpad(number.cast("string"), 3, "0"), F.regexp_extract(T.basename(image), r"^.+(\.[^.]+)$", 1), F.lit("]"))

    lines = F.concat(F.array("text"), F.transform(F.coalesce("images", F.array().cast("array<string>")), marker), F.array(F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", lines.alias("lines"))))
    text = F.array_join(F.flatten(F.transform(ordered, lambda x: x["lines"])), "\n")
    return rows.groupBy(*keys).agg(F.concat(T.strip(text), F.lit("\n")).alias("preview"))
