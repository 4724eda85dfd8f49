"""Word-processing archives: entries within bounds, relationships, paragraphs with formulas and image tokens, table rows.

Archives are unzipped in Python, one after another in Arrow batches; everything after that is columns over pieces of XML.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.latex import clean_texts
from paperloom.functions.text import SPACE, once, trimmed
from paperloom.tables import written

# Entries that are read, media types, kinds that can be shown, what stands for a picture that can't.
DOCUMENT, RELATIONS = "word/document.xml", "word/_rels/document.xml.rels"
MIME = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "bmp": "image/bmp", "emf": "image/emf", "wmf": "image/wmf", "bin": "application/octet-stream"}
SHOWN = ["png", "jpg", "jpeg", "gif", "webp", "svg"]
METAFILES = ["wmf", "emf"]
OPEN_PICTURE = "公式图片待转换"
TEXT_TAGS = "w:t|m:t|w:instrText|w:delText"
PIECES = (
    "<m:oMathPara[\\s\\S]*?</m:oMathPara>|<m:oMath[\\s\\S]*?</m:oMath>|<(?:w:drawing|w:object)\\b[\\s\\S]*?</(?:w:drawing|w:object)>|<v:imagedata\\b[^>]*/>|<o:OLEObject\\b[^>]*/>"
    f"|<(?:{TEXT_TAGS})\\b[^>]*>[\\s\\S]*?</(?:{TEXT_TAGS})>|<w:tab\\s*/>|<w:br\\s*/>|<m:chr[^>]*m:val=[\"'][^\"']+[\"'][^>]*/>"
)
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&apos;", "'")]
#: Levels of formulas within formulas that are rewritten; deeper ones keep their plain text.
LEVELS = 6
#: Rows and code points of text at which unzipped entries leave the Python worker; an archive isn't split.
FRAME_ROWS, FRAME_CHARS = 10_000, 8_000_000


def opener(max_entry_bytes: int = 50_000_000, max_ratio: int = 200):
    """What reads a partition's archives: batches of (file_id, content) to frames of their entries, see `archive_entries`."""

    def opened(file_id: str, content: bytes | None) -> list[tuple]:
        try:
            archive = zipfile.ZipFile(io.BytesIO(content or b""))
        except (zipfile.BadZipFile, ValueError):
            return [(file_id, None, None, None, "archive-invalid")]
        rows = []
        for entry in archive.infolist():
            text = error = None
            if entry.filename in (DOCUMENT, RELATIONS):
                if entry.file_size > max_entry_bytes:
                    error = "entry-too-large"
                elif entry.file_size > max_ratio * max(1, entry.compress_size):
                    error = "ratio-exceeded"
                else:
                    try:
                        with archive.open(entry) as part:
                            read = part.read(max_entry_bytes + 1)
                        text, error = (None, "entry-too-large") if len(read) > max_entry_bytes else (read.decode("utf-8-sig", "replace"), None)
                    except (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError):
                        error = "entry-damaged"
            rows.append((file_id, entry.filename, entry.file_size, text, error))
        return rows

    def framed(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["file_id", "entry", "bytes", "text", "error"]).astype({"bytes": "Int64"})

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for batch in batches:
            for file_id, content in zip(batch["file_id"], batch["content"]):
                found = opened(file_id, content)
                rows += found
                held += sum(len(r[3]) for r in found if r[3])
                # a frame costs far more than a small archive's rows
                if len(rows) >= FRAME_ROWS or held >= FRAME_CHARS:
                    yield framed(rows)
                    rows, held = [], 0
        if rows:
            yield framed(rows)

    return each


def archive_entries(files: DataFrame, max_entry_bytes: int = 50_000_000, max_ratio: int = 200) -> DataFrame:
    """(file_id, entry, bytes, text, error) of every entry of the archives (file_id string, content binary).

    The text is read of the document and its relationships alone. An archive that can't be opened has one row with the error
    archive-invalid; an entry that is, or unpacks to, more than the bounds has entry-too-large or ratio-exceeded
    and no text, a damaged one entry-damaged. At most `max_entry_bytes` are unpacked of an entry. Null contents are invalid.
    """

    return files.select(F.col("file_id").cast("string").alias("file_id"), "content").mapInPandas(opener(max_entry_bytes, max_ratio), "file_id string, entry string, bytes long, text string, error string")


def _decoded(text: Column) -> Column:
    for code, sign in ENTITIES:
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def relationships(entries: DataFrame) -> DataFrame:
    """(file_id, id, target, type, ext, mime, shown, present): what the document's relations point to; of a repeated id the last counts.

    Targets are paths within the archive, and `present` tells whether it has such an entry.
    """
    found = entries.where(F.col("entry") == RELATIONS).select("file_id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("<Relationship\\b([^>]+?)/>"), F.lit(1))).alias("at", "_a"))
    of = lambda name: F.regexp_extract("_a", f"\\b{name}=[\"']([^\"']+)[\"']", 1)
    named = found.select("file_id", "at", of("Id").alias("id"), F.translate(of("Target"), "\\", "/").alias("_t"), of("Type").alias("type")).where("id != '' AND _t != ''")
    target = F.when(F.col("_t").startswith("word/"), F.col("_t")).when(F.col("_t").startswith("/"), F.regexp_replace("_t", "^/+", "")).otherwise(F.concat(F.lit("word/"), F.regexp_replace("_t", "^(\\.\\./)+", "")))
    last = named.withColumn("_n", F.row_number().over(Window.partitionBy("file_id", "id").orderBy(F.desc("at")))).where("_n = 1").withColumn("target", target)
    ext = F.lower(F.regexp_extract("target", "\\.([a-zA-Z0-9]+)$", 1))
    mimes = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    there = entries.where("entry IS NOT NULL").select("file_id", F.col("entry").alias("target"), F.lit(True).alias("present")).distinct()
    typed = last.withColumn("ext", ext).withColumn("mime", F.coalesce(F.try_element_at(mimes, F.col("ext")), F.lit("application/octet-stream"))).withColumn("shown", F.col("ext").isin(SHOWN))
    return typed.join(there, ["file_id", "target"], "left").select("file_id", "id", "target", "type", "ext", "mime", "shown", F.coalesce("present", F.lit(False)).alias("present"))


def formula(xml: Column, levels: int = LEVELS) -> Column:
    """A formula's markup as LaTeX between dollar signs, from its innermost parts outwards; empty if nothing is left."""
    inner, gap = "([^<]*)", "\\s*"
    tag = lambda name: f"<m:{name}>{inner}</m:{name}>"
    maybe = lambda name: f"(?:<m:{name}>{inner}</m:{name}>|<m:{name}/>)?"
    whole = lambda name, *parts: f"<m:{name}>{gap}" + gap.join(parts) + f"{gap}</m:{name}>"
    first = [
        ("<m:naryPr>(?:(?!</m:naryPr>)[\\s\\S])*?<m:chr[^>]*m:val=[\"']([^\"']*)[\"'][^>]*/>[\\s\\S]*?</m:naryPr>", "<m:chr>$1</m:chr>"),
        ("<(m|w):(\\w*Pr)\\b[^>]*(?<!/)>[\\s\\S]*?</\\1:\\2>", ""), ("<[mw]:\\w*Pr\\b[^>]*/>", ""), ("<m:t\\b[^>]*(?<!/)>([^<]*)</m:t>", "$1"), ("</?m:r\\b[^>]*>", ""), ("<m:(\\w+)\\s[^>]*(?<!/)>", "<m:$1>"),
    ]
    rules = [
        (whole("f", tag("num"), tag("den")), "\\\\frac{$1}{$2}"), (whole("sSup", tag("e"), tag("sup")), "$1^{$2}"), (whole("sSub", tag("e"), tag("sub")), "$1_{$2}"), (whole("sSubSup", tag("e"), tag("sub"), tag("sup")), "$1_{$2}^{$3}"),
        (whole("rad", "(?:<m:deg></m:deg>|<m:deg/>)?", tag("e")), "\\\\sqrt{$1}"), (whole("rad", tag("deg"), tag("e")), "\\\\sqrt[$1]{$2}"), (whole("bar", tag("e")), "\\\\overline{$1}"),
        (whole("d", tag("e") + f"(?:{gap}<m:e>[^<]*</m:e>)*"), "\\\\left($1\\\\right)"), (whole("nary", maybe("chr"), maybe("sub"), maybe("sup"), tag("e")), "\ue000$1\ue001\ue002$2\ue003\ue004$3\ue005$4"),
    ]
    last = [("\ue000\ue001", "\\\\sum"), ("[\ue000\ue001]|\ue002\ue003|\ue004\ue005", ""), ("\ue002", "_{"), ("\ue004", "^{"), ("[\ue003\ue005]", "}"), ("<[^>]*>", "")]
    out = xml
    for pattern, new in [*first, *rules * levels, *last]:
        out = F.regexp_replace(out, pattern, new)
    out = trimmed(F.regexp_replace(_decoded(out), f"[{SPACE}]+", " "))
    return once(out, lambda t: F.when(t != "", F.concat(F.lit("$"), t, F.lit("$"))).otherwise(""))


def _normal(text: Column) -> Column:
    """Full-width signs narrowed, hard spaces and runs of blanks as one, at most one blank line, none at the ends."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    folded = F.translate(text, wide + "\xa0", "".join(chr(c) for c in range(0x21, 0x7F)) + " ")
    return trimmed(F.regexp_replace(F.regexp_replace(folded, "[ \\t]{2,}", " "), "\\n{3,}", "\n\n"))


def paragraphs(entries: DataFrame, relations: DataFrame) -> DataFrame:
    """(file_id, paragraph, text, has_object) of the documents' paragraphs, from 0; those without text or object are left out, their numbers too.

    Text runs, tabs, breaks and formulas are joined by blanks. An object becomes the token of the first picture it refers to
    that can be shown and is present, `[[IMAGE:<relation>]]`, else a placeholder with the kind of a picture that can't; one
    without a known relation leaves nothing. Documents without text have no rows.
    """
    documents = entries.where((F.col("entry") == DOCUMENT) & F.col("text").isNotNull())
    cut = documents.select("file_id", F.posexplode(F.regexp_extract_all("text", F.lit("(<w:p[\\s\\S]*?</w:p>)"), F.lit(1))).alias("_p", "_xml"))
    pieces = cut.select("file_id", "_p", F.posexplode(F.regexp_extract_all("_xml", F.lit(f"({PIECES})"), F.lit(1))).alias("_at", "_x"))
    x = F.col("_x")
    drawn = x.rlike("^<(?:w:drawing|w:object|v:imagedata|o:OLEObject)\\b")
    char = F.regexp_extract(x, "m:val=[\"']([^\"']+)[\"']", 1)
    plain = _decoded(F.regexp_replace(x, f"^<(?:{TEXT_TAGS})\\b[^>]*>|</(?:{TEXT_TAGS})>$", ""))
    said = F.when(drawn, None).when(x.startswith("<m:oMath"), formula(x)).when(x.startswith("<w:tab"), " ").when(x.startswith("<w:br"), "\n").when(x.startswith("<m:chr"), char).otherwise(plain)
    rids = F.concat(*[F.regexp_extract_all(x, F.lit(f"\\b{a}=[\"']([^\"']+)[\"']"), F.lit(1)) for a in ("r:embed", "r:id", "o:relid")])
    held = written(pieces.select("file_id", "_p", "_at", said.alias("_said"), drawn.alias("_drawn"), F.when(drawn, rids).alias("_rids")))
    asked = held.where("_drawn").select("file_id", "_p", "_at", F.posexplode("_rids").alias("_o", "id"))
    met = asked.join(relations, ["file_id", "id"])
    rank = F.when(F.col("shown") & F.col("present"), 0).when(F.col("ext").isin(METAFILES), 1).otherwise(2)
    kind = F.when(F.col("ext") == "", "unknown").otherwise(F.col("ext"))
    token = F.when(rank == 0, F.concat(F.lit("[[IMAGE:"), "id", F.lit("]]"))).otherwise(F.concat(F.lit(f"[{OPEN_PICTURE}:"), kind, F.lit("]")))
    tokens = met.groupBy("file_id", "_p", "_at").agg(F.min(F.struct(rank.alias("r"), "_o", token.alias("t"))).alias("_k")).select("file_id", "_p", "_at", F.col("_k.t").alias("_token"))
    told = held.join(tokens, ["file_id", "_p", "_at"], "left").withColumn("_part", F.coalesce("_said", "_token", F.lit("")))
    gathered = told.groupBy("file_id", "_p").agg(F.array_sort(F.collect_list(F.when(F.col("_part") != "", F.struct("_at", "_part")))).alias("_l"), F.max("_drawn").alias("has_object"))
    texts = gathered.select("file_id", "_p", _normal(F.array_join(F.transform("_l", lambda p: p["_part"]), " ")).alias("text"), "has_object").where("text != '' OR has_object")
    return texts.select("file_id", (F.row_number().over(Window.partitionBy("file_id").orderBy("_p")) - 1).alias("paragraph"), "text", "has_object")


def _option(text: Column) -> Column:
    folded = F.translate(text, "ＡＢＣＤ", "ABCD")
    return trimmed(F.regexp_replace(F.regexp_replace(folded, f"(?i)^[A-D][{SPACE}]*[.．、:：)）][{SPACE}]*", ""), f"[{SPACE}]+", " "))


def table_rows(entries: DataFrame) -> DataFrame:
    """(file_id, table, row, n_cells, text) of the documents' table rows that have a cell with text, numbered from 0.

    A row of four cells, two of which at least are more than an option mark, is a list of options: `A. x B. y C. z D. w`. Two cells are parted by
    four blanks, other numbers by one.
    """
    documents = entries.where((F.col("entry") == DOCUMENT) & F.col("text").isNotNull())
    inner = lambda c, tag: F.regexp_extract_all(c, F.lit(f"(<w:{tag}[\\s\\S]*?</w:{tag}>)"), F.lit(1))
    tables = documents.select("file_id", F.posexplode(inner("text", "tbl")).alias("table", "_x"))
    rows = tables.select("file_id", "table", F.posexplode(inner("_x", "tr")).alias("row", "_x"))
    cells = rows.select("file_id", "table", "row", F.posexplode(inner("_x", "tc")).alias("_c", "_x"))
    bare = lambda t: trimmed(F.regexp_replace(F.regexp_replace(_decoded(t), "<[^>]+>", ""), f"[{SPACE}]+", " "))
    runs = F.filter(F.transform(F.regexp_extract_all("_x", F.lit(f"<(?:{TEXT_TAGS})\\b[^>]*>([\\s\\S]*?)</(?:{TEXT_TAGS})>"), F.lit(1)), bare), lambda t: t != "")
    chars = F.regexp_extract_all("_x", F.lit("<m:chr[^>]*m:val=\"([^\"]+)\"[^>]*/>"), F.lit(1))
    text = once(F.concat(runs, chars), lambda p: F.when(F.size(p) > 0, F.array_join(p, " ")).otherwise(bare(F.col("_x"))))
    cleaned = clean_texts(cells.select("file_id", "table", "row", "_c", text.alias("_t")), "_t").where("_t != ''")
    options = clean_texts(cleaned.withColumn("_o", _option(F.col("_t"))), "_o")
    listed = options.groupBy("file_id", "table", "row").agg(F.array_sort(F.collect_list(F.struct("_c", "_t", "_o"))).alias("_l"))
    parts = lambda name: F.transform("_l", lambda c: c[name])
    said = F.size(F.filter(parts("_o"), lambda o: o != ""))
    marks = F.array_join(F.zip_with(F.array(*[F.lit(f"{m}. ") for m in "ABCD"]), parts("_o"), lambda m, o: F.concat(m, o)), " ")
    joined = F.when((F.size("_l") == 4) & (said >= 2), marks).when(F.size("_l") == 2, F.array_join(parts("_o"), "    ")).otherwise(F.array_join(parts("_t"), " "))
    return listed.select("file_id", "table", "row", F.size("_l").alias("n_cells"), joined.alias("text"))
