"""Admission, classification, planning, decoding and cutting of files."""

from __future__ import annotations

import ast
import io
import re
import signal
import threading
import unicodedata
import zipfile
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions of each kind, lower case.
EXTENSIONS = {
    "text": "txt md markdown rst log csv json yaml yml toml ini cfg".split(),
    "code": "rs py js jsx mjs cjs ts tsx java c h cc cpp cxx hpp hh go cs rb php sh bash kt kts swift".split(),
    "pdf": ["pdf"],
    "office": "docx pptx xlsx".split(),
    "image": "png jpg jpeg webp gif bmp tiff tif heic heif".split(),
    "other": "arw cr2 cr3 crw dng nef nrw orf pef raf raw rw2 srw x3f".split(),
}
# What is left out by default, and folders that are one item.
EXCLUDED = [
    "**/node_modules/**", "**/.git/**", "**/target/**", "**/.venv/**", "**/__pycache__/**", "**/*.tmp", "**/*.part", "**/*.crdownload", "**/~$*", "**/.~lock.*",
    "**/Library/PackageCache/**", "**/Library/Bee/**", "**/Library/ShaderCache/**", "**/Library/BurstCache/**", "**/Library/ScriptAssemblies/**",
    "**/*.meta", "**/*.dll", "**/*.pdb", "**/*.obj", "**/*.o",
]
BUNDLES = [".app", ".photoslibrary", ".bundle", ".framework"]
MAX_BYTES = 50 * 1024 * 1024
PREFIX_BYTES, SNIFFED = 64 * 1024, 8192
LINES, LINE_STEP = 100, 90
OCR_LEAST = 6
#: Seconds that one file's extraction may take.
EXTRACT_SECONDS = 60


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def sniffed(header: Column) -> Column:
    """The kind that the first bytes of a file say, or null."""
    hexed = F.hex(header)
    starts = lambda *p: F.greatest(*[hexed.startswith(x) for x in (*p, p[0])])
    image = starts("89504E47", "FFD8FF", "47494638", "424D", "49492A00", "4D4D002A") | (hexed.startswith("52494646") & (F.substring(hexed, 17, 8) == "57454250"))
    return F.when(hexed.startswith("25504446"), "pdf").when(image, "image")


def kind_of(path: Column, header: Column | None = None) -> Column:
    """text, code, pdf, office, image or other: by extension, else by the header's bytes."""
    ext = extension(path)
    kind = F.when(F.lit(False), "")
    for name, known in EXTENSIONS.items():
        kind = kind.when(ext.isin(known), name)
    return kind.otherwise(F.lit("other") if header is None else F.coalesce(sniffed(header), F.lit("other")))


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob in which * crosses /; **/ matches any folders or none, [..] one of some characters, {a,b} either.

    A bracket that is not closed is an error.
    """
    out, k, depth = [], 0, 0
    while k < len(glob):
        c = glob[k]
        if glob.startswith("**/", k):
            out.append("(?:.*/)?")
            k += 3
            continue
        if c == "*":
            out.append(".*")
            k += 2 if glob.startswith("**", k) else 1
            continue
        if c == "[":
            end = glob.find("]", k + 2 + glob.startswith("!", k + 1))
            if end < 0:
                raise ValueError(f"not a glob: {glob}")
            inside = glob[k + 1 : end]
            negated = inside.startswith("!")
            out.append("[" + ("^" if negated else "") + re.sub(r"([\\\[\]^&~|])", r"\\\1", inside[negated:]) + "]")
            k = end + 1
            continue
        if c in "{}" or (c == "," and depth):
            depth += (c == "{") - (c == "}")
            out.append({"{": "(?:", "}": ")", ",": "|"}[c])
        else:
            out.append("." if c == "?" else re.escape(c))
        k += 1
    if depth:
        raise ValueError(f"not a glob: {glob}")
    return f"^{''.join(out)}$"


def is_wanted(rel_path: Column, hidden: bool = False, globs: list[str] | None = None) -> Column:
    """Whether a root-relative path is walked: no hidden part, no excluded prefix, nothing inside a bundle."""
    wanted = F.lit(True)
    if not hidden:
        wanted = wanted & ~rel_path.rlike(r"(^|/)\.[^/]")
    for glob in EXCLUDED if globs is None else globs:
        folder = glob.removesuffix("/**")
        wanted = wanted & ~rel_path.rlike(glob_pattern(glob)) & ~rel_path.rlike(glob_pattern(folder)[:-1] + "(/|$)") if folder != glob else wanted & ~rel_path.rlike(glob_pattern(glob))
    inside = "|".join(re.escape(b) for b in BUNDLES)
    return wanted & ~F.lower(rel_path).rlike(rf"({inside})/")


def plan(path: Column, size: Column, cloud_only: Column, is_dir: Column, enabled_kinds: list[str], max_bytes: int = MAX_BYTES, header: Column | None = None) -> Column:
    """struct(plan, skip_reason, kind) in the order: in the cloud, a bundle, too large, nothing to extract, extract.

    ``header``, the file's first SNIFFED bytes, settles the kind of files whose extension says nothing, but only
    of those that may be read.
    """
    named, kind = kind_of(path), kind_of(path, header)
    row = lambda p, r, k: F.struct(F.lit(p).alias("plan"), F.lit(r).cast("string").alias("skip_reason"), k.alias("kind"))
    return (
        F.when(cloud_only, row("skip", "cloud_only", named))
        .when(is_dir, row("skip", "bundle", F.lit("other")))
        .when(size > max_bytes, row("skip", "too_large", named))
        .when((kind == "other") | ~kind.isin(enabled_kinds), row("name_only", None, kind))
        .otherwise(row("extract", None, kind))
    )


def data_prefix(content: Column, most: int = PREFIX_BYTES) -> Column:
    """A long data file's first ``most`` bytes, cut after the last line that is whole; ``content`` is binary and so is the result.

    The bytes are looked at as Latin-1, one character each, so positions are bytes.
    """
    head = F.decode(F.substring(content, 1, most), "ISO-8859-1")
    lines = F.regexp_extract(head, r"(?s)^(.*\n)", 1)
    return F.when(F.length(content) <= most, content).otherwise(F.encode(F.when(lines == "", head).otherwise(lines), "ISO-8859-1"))


# Extensions of files of data, of which only a beginning is read.
DATA = ["csv", "json"]


def data_head(data: bytes, most: int = PREFIX_BYTES) -> bytes:
    """``data_prefix`` of one file."""
    return data if len(data) <= most else data[: data.rfind(b"\n", 0, most) + 1] or data[:most]


def line_windows(df: DataFrame, text: str = "text") -> DataFrame:
    """Windows of LINES lines every LINE_STEP lines, blank ones left out: columns of df, line_start, line_end (from 1, inclusive), window."""
    lines = F.split(F.col(text), "\n")
    n = F.size(lines)
    count = F.when(n <= LINES, 1).otherwise(1 + F.ceil((n - LINES) / LINE_STEP)).cast("int")
    rows = df.withColumn("_lines", lines).withColumn("_i", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.col("_i") * LINE_STEP
    rows = rows.withColumn("line_start", (start + 1).cast("long")).withColumn("line_end", F.least(start + LINES, F.size("_lines")).cast("long"))
    rows = rows.withColumn("window", F.array_join(F.slice("_lines", F.col("_i") * LINE_STEP + 1, LINES), "\n"))
    return rows.filter(F.col("window").rlike(r"\S")).drop("_lines", "_i")


def ocr_kept(text: Column) -> Column:
    """Whether recognised text has enough letters and digits to be more than noise."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")) >= OCR_LEAST


def ocr_chunks(texts: DataFrame) -> DataFrame:
    """Rows (path, text) of recognised text as ocr chunks, those that are noise left out."""
    return texts.filter(ocr_kept(F.col("text"))).select("path", F.lit("ocr").alias("source"), "text")


def reading_order(boxes: DataFrame) -> DataFrame:
    """``boxes`` (image, x, y, height, text) with row and place: rows from the top, a box begins one if it is lower than half a height
    below the first box of the row before; within a row from the left."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["y", "x"], kind="stable")
        row, top, half, rows_ = -1, 0.0, 0.0, []
        for y, height in zip(f["y"], f["height"], strict=True):
            if row < 0 or y - top > half:
                row, top, half = row + 1, y, height / 2
            rows_.append(row)
        f = f.assign(row=rows_).sort_values(["row", "x", "y"], kind="stable")
        return f.assign(place=range(len(f)))[["image", "x", "y", "height", "text", "row", "place"]]

    kind = dict(boxes.dtypes)["image"]
    return boxes.select("image", "x", "y", "height", "text").groupBy("image").applyInPandas(run, f"image {kind}, x double, y double, height double, text string, row long, place long")


def ctc_collapse(df: DataFrame, keys: list[str], order: str, symbol: str, blank) -> DataFrame:
    """Symbols in order without repeats of the one before, then without blanks."""
    from pyspark.sql import Window

    before = F.lag(symbol).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_before", before).filter(~F.col(symbol).eqNullSafe(F.col("_before")) & (F.col(symbol) != blank)).drop("_before")


# Extractors: (path, bytes) to chunks. A seam takes what this box has no decoder for.

CHUNK_SCHEMA = "path string, ordinal int, source string, text string, page int, line_start int, line_end int, lang string, error string"
Extractor = Callable[[str, bytes], list[dict]]
_SEAMS: dict[str, Extractor] = {}


def register_extractor(kind: str, extractor: Extractor) -> None:
    """Use ``extractor`` for files of a kind (image has none of its own; see ``image_extractor``)."""
    _SEAMS[kind] = extractor


def decode_text(data: bytes) -> str:
    """UTF-8 or UTF-16 by its mark, UTF-8 if valid, else cp1252; in composed normal form."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return unicodedata.normalize("NFC", data.decode(name, "replace"))
    try:
        return unicodedata.normalize("NFC", data.decode("utf-8"))
    except UnicodeDecodeError:
        return unicodedata.normalize("NFC", data.decode("cp1252", "replace"))


# Frequent short words that tell languages apart.
_FREQUENT = {
    "en": "the and of to in is that for with was".split(),
    "es": "de la que el en los para una por con".split(),
    "fr": "le la les des et un une dans que pour".split(),
    "de": "der die und das ist von mit den ein nicht".split(),
}


def detect_language(text: str) -> str | None:
    """The language whose frequent words a text has most of, clearly; else None."""
    words = re.findall(r"[^\W\d_]+", text.lower())
    if len(words) < 5:
        return None
    scores = sorted(((sum(w in set(f) for w in words) / len(words), lang) for lang, f in _FREQUENT.items()), reverse=True)
    return scores[0][1] if scores[0][0] >= 0.08 and scores[0][0] >= 1.3 * scores[1][0] else None


def greedy_chunks(text: str, most: int = 400, overlap: int = 50, count: Callable[[str], int] = lambda w: 1) -> list[str]:
    """Chunks of whole words up to ``most`` tokens, each beginning ``overlap`` tokens or more before the last one's end."""
    units = re.findall(r"\S+\s*", text.strip())
    known: dict[str, int] = {}
    size = [known.setdefault(u, max(1, count(u.strip()))) for u in units]
    out, start = [], 0
    while start < len(units):
        end, total = start, 0
        while end < len(units) and (end == start or total + size[end] <= most):
            total += size[end]
            end += 1
        out.append("".join(units[start:end]).strip())
        if end == len(units):
            break
        back, shared = end, 0
        while back > start + 1 and shared < overlap:
            back -= 1
            shared += size[back]
        start = max(back, start + 1)
    return out


def code_blocks(source: str, suffix: str) -> list[tuple[int, int]]:
    """(first, last) lines, from 1, of top-level blocks: by syntax for Python, else by unindented lines after blank ones."""
    lines = source.split("\n")
    if suffix == "py":
        try:
            nodes = [(min([n.lineno, *[d.lineno for d in getattr(n, "decorator_list", [])]]), n.end_lineno) for n in ast.parse(source).body]
            return nodes
        except (SyntaxError, ValueError, RecursionError):
            pass
    starts = [i for i, line in enumerate(lines) if line.strip() and not line[0].isspace() and line[0] not in "})]" and (i == 0 or not lines[i - 1].strip())]
    return [(a + 1, b) for a, b in zip(starts, [*starts[1:], len(lines)], strict=True)]


def code_chunks(source: str, suffix: str, most: int = 400) -> list[dict]:
    """Neighbouring blocks merged up to ``most`` words, each cut further if need be, with the block's lines."""
    lines, merged = source.split("\n"), []
    for first, last in code_blocks(source, suffix):
        words = len(" ".join(lines[first - 1 : last]).split())
        if merged and merged[-1][2] + words <= most:
            merged[-1] = (merged[-1][0], last, merged[-1][2] + words)
        else:
            merged.append((first, last, words))
    if not merged:
        merged = [(i + 1, min(i + LINES, len(lines)), 0) for i in range(0, max(1, len(lines) - LINES + LINE_STEP), LINE_STEP)]
    return [{"source": "code_symbol", "text": t, "line_start": a, "line_end": b} for a, b, _ in merged for t in greedy_chunks("\n".join(lines[a - 1 : b]), most) if t]


def _runs(xml: bytes) -> str:
    """The text runs of an office part, a line for each paragraph."""
    out: list[str] = []
    for e in ElementTree.fromstring(xml).iter():
        name = e.tag.rpartition("}")[2]
        if name == "p" and out and out[-1] != "\n":
            out.append("\n")
        elif name == "t" and e.text:
            out.append(e.text)
    return "".join(out).strip()


def office_pages(data: bytes) -> list[str]:
    """Texts of a document's body, a deck's slides or a workbook's sheets, in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        if "word/document.xml" in names:
            return [_runs(z.read("word/document.xml"))]
        number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
        slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
        if slides:
            return [_runs(z.read(n)) for n in slides]
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter() if t.tag.endswith("}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        pages = []
        for n in sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=number):
            lines = []
            for row in (e for e in ElementTree.fromstring(z.read(n)).iter() if e.tag.endswith("}row")):
                cells = []
                for c in row:
                    v = next((x.text or "" for x in c.iter() if x.tag.rpartition("}")[2] in ("v", "t")), "")
                    cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                lines.append(" ".join(x for x in cells if x))
            pages.append("\n".join(x for x in lines if x))
        return pages


# Pictures: codes before recognised text; what fails costs only its own part.

MOST_PIXELS = 100_000_000
#: Pictures up to this size are also looked at in tiles.
TILED_PIXELS, TILES, SCALES = 6_000_000, 2, (1, 2, 4, 8)
ImageReader = Callable[[bytes], object]


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF, BMP or JPEG file, without decoding it."""
    if data.startswith(b"\x89PNG\r\n\x1a\n") and len(data) >= 24:
        return int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:4] == b"GIF8" and len(data) >= 10:
        return int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:2] == b"BM" and len(data) >= 26:
        return int.from_bytes(data[18:22], "little"), abs(int.from_bytes(data[22:26], "little", signed=True))
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            if data[at + 1] in range(0xC0, 0xD0) and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def tiles(width: int, height: int) -> list[tuple[int, int, int, int]]:
    """(left, top, right, bottom) of TILES x TILES parts of a picture that overlap by half their size."""
    w, h = -(-2 * width // (TILES + 1)), -(-2 * height // (TILES + 1))
    return [(min(i * w // 2, width - w), min(j * h // 2, height - h), min(i * w // 2, width - w) + w, min(j * h // 2, height - h) + h) for j in range(TILES) for i in range(TILES)]


def code_payloads(picture, width: int, height: int, scaled: Callable, cropped: Callable, decode: Callable[[object], list[str]]) -> list[str]:
    """What the codes in a picture say, each once: the first of SCALES at which any is found; small pictures in tiles too.

    ``scaled(picture, n)`` is it n times smaller, ``cropped(picture, box)`` a part of it, ``decode`` a decoder's.
    """
    found: list[str] = []
    for n in SCALES:
        found = decode(picture if n == 1 else scaled(picture, n))
        if found:
            break
    if width * height <= TILED_PIXELS:
        for box in tiles(width, height):
            found = found + decode(cropped(picture, box))
    return list(dict.fromkeys(found))


def image_extractor(codes: Callable[[bytes], list[str]] | None = None, recognise: Callable[[bytes], str] | None = None) -> Extractor:
    """An extractor of pictures from a reader of codes and one of text, either of which may be absent or fail."""

    def extract(path: str, data: bytes) -> list[dict]:
        size = image_size(data)
        if size and size[0] * size[1] > MOST_PIXELS:
            return [{"error": "image_too_large"}]
        out = []
        for source, read in (("qr", codes), ("ocr", recognise)):
            try:
                found = read(data) if read else []
            except Exception:  # noqa: BLE001 - a model that fails costs only its part
                continue
            for text in [found] if isinstance(found, str) else found:
                if source == "qr" or sum(c.isalnum() for c in text) >= OCR_LEAST:
                    out += [{"source": source, "text": t} for t in greedy_chunks(text)]
        return out

    return extract


# Documents of pages: the texts that the pages' own operators draw, as far as they are in a plain encoding.

_PDF_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_PDF_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_PDF_FILTER = re.compile(rb"/Filter\s*(?:/(\w+)|\[\s*([^\]]*?)\s*\])")
_PDF_TEXT = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\b(?:Tj|TJ|Td|TD|ET)\b|\bT\*|(?<=\s)['\"]", re.S)
_PDF_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}


def _pdf_string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")
    data = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _PDF_ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


def pdf_pages(data: bytes) -> list[str]:
    """The text of each page of a plain PDF file; fonts with their own codes are read as they are.

    Encrypted files, files none of whose pages is found (they may stand in object streams) and pages behind a filter that is
    not read here are errors, so that no file counts as read without its text.
    """
    if b"/Encrypt" in data:
        raise ValueError("password")
    objects = {int(m[1]): m[2] for m in _PDF_OBJECT.finditer(data)}
    pages = []
    for body in objects.values():
        if not re.search(rb"/Type\s*/Page\b(?!s)", body):
            continue
        contents = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        out: list[str] = []
        for number in re.findall(rb"(\d+)\s+\d+\s+R", contents[1] if contents else b""):
            part = objects.get(int(number), b"")
            stream = _PDF_STREAM.search(part)
            if stream:
                filters = [x for m in [_PDF_FILTER.search(part[: stream.start()])] if m for x in re.findall(rb"\w+", m[1] or m[2])]
                if filters not in ([], [b"FlateDecode"]):
                    raise ValueError("filter")
                raw = zlib.decompressobj().decompress(stream[1]) if filters else stream[1]
                for token in _PDF_TEXT.findall(raw):
                    if token[:1] in b"(<":
                        out.append(_pdf_string(token))
                    elif token in (b"Td", b"TD", b"T*", b"ET", b"'", b'"'):
                        out.append("\n")
        pages.append(re.sub(r"\n+", "\n", "".join(out)).strip())
    if not pages:
        raise ValueError("no_pages")
    return pages


def extract_one(path: str, kind: str, data: bytes) -> list[dict]:
    """The chunks of one file; an error becomes a row of its own, never a failed task."""
    try:
        if kind in _SEAMS:
            return _SEAMS[kind](path, data)
        if kind == "text":
            if path.rpartition(".")[2].lower() in DATA:
                data = data_head(data)
            text = decode_text(data).strip()
            return [{"source": "body", "text": t, "lang": detect_language(text)} for t in greedy_chunks(text)] if text else []
        if kind == "code":
            return code_chunks(decode_text(data), path.rpartition(".")[2].lower())
        if kind in ("office", "pdf"):
            pages = office_pages(data) if kind == "office" else pdf_pages(data)
            lang = detect_language("\n".join(pages))
            return [{"source": "body", "text": t, "page": n, "lang": lang} for n, p in enumerate(pages, 1) if p.strip() for t in greedy_chunks(p)]
        return [{"error": f"no extractor for {kind}"}]
    except Exception as e:  # noqa: BLE001 - a broken file is a row with an error
        return [{"error": f"{type(e).__name__}: {e}"[:200]}]


class TooSlow(Exception):
    """An extractor took longer than it may."""


@contextmanager
def time_limit(seconds: int) -> Iterator[None]:
    """Stop what runs longer, where the worker's main thread lets a signal do it."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def stop(signum, frame):
        raise TooSlow(f"over {seconds} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.alarm(seconds)
    try:
        yield
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)


def extract_within(path: str, kind: str, data: bytes, seconds: int = EXTRACT_SECONDS) -> list[dict]:
    try:
        with time_limit(seconds):
            return extract_one(path, kind, data)
    except TooSlow as e:
        return [{"error": str(e)}]


def extracted(files: DataFrame) -> DataFrame:
    """Chunks of (path, kind, content) rows."""
    columns = [c.split(" ")[0] for c in CHUNK_SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [{"path": p, "ordinal": i, **c} for p, k, d in zip(f["path"], f["kind"], f["content"], strict=True) for i, c in enumerate(extract_within(p, k, bytes(d)))]
            yield pd.DataFrame(found, columns=columns, dtype=object).astype({c: "Int32" for c in ("ordinal", "page", "line_start", "line_end")})

    return files.select("path", "kind", "content").mapInPandas(run, CHUNK_SCHEMA)


def read_files(files: DataFrame, enabled_kinds: list[str], max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, chunks) of files (path, rel_path, size, cloud_only, is_dir, content): plan, read, cut and name in one.

    rows: path, kind, plan, skip_reason, content_hash, error, state. chunks: path, ordinal, source, text, page, lines and
    lang; the last one of every file is its name. Only what the plan extracts is read; an error keeps the name.
    """
    from trovelens.functions.text import name_words

    p = plan(F.col("path"), F.col("size"), F.col("cloud_only"), F.col("is_dir"), enabled_kinds, max_bytes, F.substring("content", 1, SNIFFED))
    planned = files.select("path", "rel_path", p.alias("p"), F.when(p["plan"] == "extract", F.col("content")).alias("content")).withColumn("content_hash", F.sha2("content", 256))
    read = extracted(planned.filter("p.plan = 'extract'").select("path", "p.kind", "content"))
    errors = read.filter("error IS NOT NULL").groupBy("path").agg(F.min("error").alias("error"))
    body = read.filter("error IS NULL").select("path", "ordinal", "source", "text", "page", "line_start", "line_end", "lang")
    last = body.groupBy("path").agg((F.max("ordinal") + 1).alias("n"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("page", "int"), ("line_start", "int"), ("line_end", "int"), ("lang", "string"))]
    names = planned.join(last, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("ordinal"), F.lit("filename").alias("source"), name_words(F.col("rel_path")).alias("text"), *none)
    state = F.when(F.col("error").isNotNull(), "error").when(F.col("p.plan") == "skip", "skipped").otherwise("indexed")
    # Hashes go to the join, contents do not.
    rows = planned.drop("content", "rel_path").join(errors, "path", "left").select("path", "p.kind", "p.plan", "p.skip_reason", "content_hash", "error", state.alias("state"))
    return rows, body.unionByName(names)
