"""Jobs over many files: charsets, content formats, archives.

Files are rows with ``content``, as :func:`tidegate.sources.files.read_files` gives them; Spark
spreads the files over tasks, and the helpers below look at one file each.
"""

import codecs
import contextlib
import csv
import io
import json
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegate.functions.charset_models import common_share, decodes, single_byte
from tidegate.sources.files import file_system, leaves_folder, read_heads

# Byte-order marks and the charsets that they stand for, longer marks first.
_MARKS = (
    (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"),
    (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"),
)
# Charsets for content that is not UTF-8, besides latin-1, which fits any bytes.
_LEGACY = ("euc_jp", "cp932", "euc_kr", "gb18030")
_KANA = re.compile("[\u3041-\u30ff]")
_HANGUL = re.compile("[\uac00-\ud7a3]")
_WIDE = re.compile("[\u3000-\u30ff\u4e00-\u9fff\uac00-\ud7a3\uff01-\uff5e]")
# A single wide character within a Latin word comes from two accented letters.
_LONE = re.compile("(?<=[A-Za-z])[\u3000-\u9fff\uac00-\ud7a3](?=[A-Za-z\\s]|$)")
_DELIMITERS = ",;\t|"


# Charsets.


def _plausible(text: str, charset: str) -> float:
    """How well a text in a legacy charset reads: the share of its characters that belong there."""
    odd = [c for c in text if c > "\x7f"]
    if not odd:
        return 0.0
    joined = "".join(odd)
    own = len((_HANGUL if charset == "euc_kr" else _WIDE).findall(joined))
    # Kana is what tells Japanese from other readings of the same bytes.
    kana = 0.0
    if charset in ("euc_jp", "cp932"):
        kana, own = len(_KANA.findall(joined)), own * 0.7
    return (own + kana - 3 * len(_LONE.findall(text))) / len(odd)


def _guess_charset(raw: bytes) -> str:
    """The charset of a whole content; one that is named decodes every byte of it."""
    for mark, name in _MARKS:
        if raw.startswith(mark):
            return name
    if b"\x1b$" in raw and raw.isascii():
        with contextlib.suppress(UnicodeDecodeError):
            raw.decode("iso2022_jp")
            return "iso2022_jp"
    try:
        raw.decode("utf-8")
        return "ascii" if raw.isascii() else "utf-8"
    except UnicodeDecodeError:
        pass
    single, reads_well = single_byte(raw)
    if reads_well and single not in ("latin-1", "cp1252"):
        return single
    best, name = 0.5, single
    for charset in _LEGACY:
        try:
            score = _plausible(raw.decode(charset), charset)
        except UnicodeDecodeError:
            continue
        if score > best:
            best, name = score, charset
    # Both charsets of Chinese decode most bytes of the other one, to rare characters.
    if name in ("gb18030", single) and not (reads_well and name == single) and decodes(raw, "big5"):
        share = common_share(raw.decode("big5"), "big5")
        if share >= 0.1 and share > common_share(raw.decode("gb18030", "replace"), "gb18030"):
            return "big5"
    return name


@F.pandas_udf(T.StringType())
def _charset_of(content: pd.Series) -> pd.Series:
    return content.map(_guess_charset, na_action="ignore")


@F.pandas_udf(T.StringType())
def _decoded(content: pd.Series, encoding: pd.Series) -> pd.Series:
    def decode(raw, name):
        return None if raw is None or name is None else raw.decode(name, "replace")

    return pd.Series([decode(raw, name) for raw, name in zip(content, encoding)], dtype=object)


@F.pandas_udf(T.BinaryType())
def _encoded(text: pd.Series, encoding: pd.Series) -> pd.Series:
    def encode(value, name):
        return None if value is None or name is None else value.encode(name, "replace")

    return pd.Series([encode(value, name) for value, name in zip(text, encoding)], dtype=object)


def detect_charset(content: Column) -> Column:
    """The charset of each content, judged by all of it.

    Byte-order marks and valid UTF-8 decide. Else it is the single-byte charset of Cyrillic, Greek,
    Central European or Turkish letters in which the words with such bytes read well and best, or the
    Japanese, Korean or Chinese charset that decodes every byte and reads best, and latin-1 (cp1252
    with its punctuation) if none does. The same bytes have the same charset on every machine.
    """
    return _charset_of(content)


def decode_text(content: Column, encoding: str | Column) -> Column:
    """Text of each content; bytes that are not valid in the charset become U+FFFD."""
    if isinstance(encoding, str):
        name = codecs.lookup(encoding).name
        if name == "utf-8":
            return F.make_valid_utf8(content.cast("string"))
        if name == "iso8859-1":
            return F.decode(content, "ISO-8859-1")
        encoding = F.lit(name)
    return _decoded(content, encoding)


def encode_text(text: Column, encoding: str | Column) -> Column:
    """Bytes of each text; characters that the charset lacks become ``?``."""
    if isinstance(encoding, str):
        if codecs.lookup(encoding).name == "utf-8":
            return F.encode(text, "UTF-8")
        encoding = F.lit(encoding)
    return _encoded(text, encoding)


def convert_encoding(
    files: DataFrame,
    source_encoding: str | None = None,
    target_encoding: str = "utf-8",
) -> DataFrame:
    """Add ``source_encoding``, ``text`` and, re-encoded, ``converted`` to files with content."""
    if source_encoding:
        encoding, text = F.lit(source_encoding), decode_text(F.col("content"), source_encoding)
    else:
        encoding = detect_charset(F.col("content"))
        text = decode_text(F.col("content"), F.col("source_encoding"))
    marked = files.withColumn("source_encoding", encoding).withColumn("text", text)
    # Line ends are unified, as reading a text file does.
    marked = marked.withColumn("text", F.regexp_replace("text", "\r\n?", "\n"))
    return marked.withColumn("converted", encode_text(F.col("text"), target_encoding))


# Content formats.


def _is_json(text: str, cut: bool) -> bool:
    for candidate in (text, text.split("\n", 1)[0].strip()):
        try:
            json.loads(candidate)
            return True
        except json.JSONDecodeError as error:
            # The start of a longer document fails only at its end.
            if not cut or candidate is not text or error.msg == "Extra data":
                continue
            rest = candidate[error.pos :]
            if error.msg.startswith(("Unterminated", "Invalid \\")) or re.fullmatch(r"[\w.+\s-]*", rest):
                return True
    return False


def _is_xml(text: str, cut: bool) -> bool:
    try:
        expat.ParserCreate("utf-8").Parse(text.encode(), not cut)
        return True
    except expat.ExpatError:
        return False


def sniff(raw: bytes, cut: bool) -> str:
    """Format of one content: unknown, binary, json, xml, csv or text."""
    if not raw:
        return "unknown"
    try:
        text = codecs.getincrementaldecoder("utf-8")().decode(raw, final=not cut).lstrip()
    except UnicodeDecodeError:
        return "binary"
    if text.startswith(("{", "[")) and _is_json(text, cut):
        return "json"
    if text.startswith("<") and _is_xml(text, cut):
        return "xml"
    if len(text) > 100:
        try:
            csv.Sniffer().sniff(text, delimiters=_DELIMITERS)
            return "csv"
        except csv.Error:
            pass
    return "text"


@F.pandas_udf(T.StringType())
def _sniffed(content: pd.Series, cut: pd.Series) -> pd.Series:
    formats = [None if raw is None else sniff(raw, short) for raw, short in zip(content, cut)]
    return pd.Series(formats, dtype=object)


def detect_format(content: Column, chunk_size: int | None = 4096) -> Column:
    """The format of each content, judged by its first bytes (all with ``chunk_size=None``)."""
    if chunk_size is None:
        return _sniffed(content, F.lit(False))
    return _sniffed(F.substring(content, 1, chunk_size), F.octet_length(content) > chunk_size)


def inspect_files(
    catalog: DataFrame, chunk_size: int = 4096, sample_size: int = 10_000, tasks: int | None = None
) -> DataFrame:
    """``(path, detected_format, detected_charset, cut)`` of the files of a catalog.

    Reads nothing but the first bytes of each file, however large it is; where ``cut`` is true
    there are more, and the whole file may be of another format or charset. Bytes that end
    within a character are cut before it.
    """
    heads = read_heads(catalog, max(chunk_size, sample_size), tasks)
    chunk = F.substring("head", 1, chunk_size)
    short = F.col("cut") | (F.octet_length("head") > chunk_size)
    return heads.select(
        "path",
        _sniffed(chunk, short).alias("detected_format"),
        detect_charset(_whole_characters(F.substring("head", 1, sample_size))).alias("detected_charset"),
        (short | (F.octet_length("head") > sample_size)).alias("cut"),
    )


@F.pandas_udf(T.BinaryType())
def _whole_characters(content: pd.Series) -> pd.Series:
    """Bytes without a UTF-8 character that the end cuts; others as they are."""

    def trimmed(raw):
        for length in range(1, min(4, len(raw) + 1)):
            if raw[-length] >= 0xC0:
                whole = 2 + (raw[-length] >= 0xE0) + (raw[-length] >= 0xF0)
                return raw[:-length] if whole > length else raw
            if raw[-length] < 0x80:
                break
        return raw

    return content.map(trimmed, na_action="ignore")


# Archives.

_MEMBERS = "archive string, member string, chunk int, content binary, error string"
_INDEX = "archive string, member string, start long, size long, error string"
_BATCH_BYTES = 32 << 20
_MEMBER_LIMIT = (1 << 31) - 1024


def member_target(name: str, strip_components: int) -> str:
    """Path of a member after its leading folders are stripped."""
    parts = name.split("/")
    return "/".join(parts[strip_components:]) if len(parts) > strip_components else parts[-1]


def _zip_members(archive: zipfile.ZipFile, part: int, parts: int):
    for info in archive.infolist()[part::parts]:
        if not info.filename.endswith("/"):
            yield info.filename, info.file_size, lambda info=info: archive.open(info)


def _tar_members(archive: tarfile.TarFile):
    for info in archive:
        if info.isfile():
            yield info.name, info.size, lambda info=info: archive.extractfile(info)


_NOTHING = "No files extracted from archive."
_LEAVES = "Member path leaves the target folder."


def _pieces(name: str, member: str, size: int, opened, chunk_bytes: int | None):
    """Rows ``(archive, member, chunk, content, error)`` of one member."""
    if chunk_bytes is None and size > _MEMBER_LIMIT:
        yield name, member, 0, None, f"Member of {size} bytes does not fit a row; set chunk_bytes."
        return
    with opened() as file:
        for chunk in range(max(1, -(-size // chunk_bytes)) if chunk_bytes else 1):
            yield name, member, chunk, file.read(chunk_bytes or -1), None


def _read_archive(name: str, handle, strip: int, part: int, parts: int, chunk_bytes: int | None = None):
    """Rows ``(archive, member, chunk, content, error)`` of one part of an archive."""
    try:
        if zipfile.is_zipfile(handle):
            handle.seek(0)
            archive = zipfile.ZipFile(handle)
            empty = all(member.endswith("/") for member in archive.namelist())
            members = _zip_members(archive, part, parts)
        elif part:
            return  # the first part reads all of an archive that has no parts
        else:
            handle.seek(0)
            archive = tarfile.open(fileobj=handle, mode="r:*")
            empty, members = None, _tar_members(archive)
        found = 0
        for member, size, opened in members:
            found += 1
            if leaves_folder(member):
                yield name, member, 0, None, _LEAVES
            else:
                yield from _pieces(name, member_target(member, strip), size, opened, chunk_bytes)
        if empty or (empty is None and found == 0):
            if part == 0:
                yield name, None, 0, None, _NOTHING
    except tarfile.ReadError:
        yield name, None, 0, None, "Unsupported archive format (not zip or tar)."
    except Exception as error:  # a broken archive is a result row, not a failed job
        yield name, None, 0, None, f"Extraction failed: {error}"


def _tar_index(name: str, handle):
    """Rows ``(archive, member, start, size, error)`` of an uncompressed tar, from its headers alone."""
    found = 0
    try:
        for info in tarfile.open(fileobj=handle, mode="r:"):
            if info.isfile():
                found += 1
                if leaves_folder(info.name):
                    yield name, info.name, None, None, _LEAVES
                elif info.issparse():
                    yield name, info.name, None, None, "Sparse members are not supported."
                elif info.offset_data + info.size > handle.size():
                    raise tarfile.ReadError("unexpected end of data")
                else:
                    yield name, info.name, info.offset_data, info.size, None
        if not found:
            yield name, None, None, None, _NOTHING
    except Exception as error:
        yield name, None, None, None, f"Extraction failed: {error}"


def _arrow_rows(rows) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size, so a task holds few members at a time."""
    names = ("archive", "member", "chunk", "content", "error")
    types = (pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string())

    def batch(kept):
        return pa.RecordBatch.from_arrays(
            [pa.array(values, type) for values, type in zip(zip(*kept), types)], names
        )

    kept, held = [], 0
    for row in rows:
        kept.append(row)
        held += len(row[3] or b"")
        if held > _BATCH_BYTES or len(kept) >= 10_000:
            yield batch(kept)
            kept, held = [], 0
    if kept:
        yield batch(kept)


def expand_archives(files: DataFrame, strip_components: int = 0, strict: bool = False) -> DataFrame:
    """Members of zip and tar(.gz/.bz2/.xz) files, as ``(archive, member, content, error)``.

    ``files`` has ``path`` and ``content``. A bad archive, an empty one and a member whose path
    leaves the target folder give a row with ``error``; with ``strict`` they fail the job.
    """

    def expand(batches):
        def rows():
            for batch in batches:
                for path, content in zip(batch["path"], batch["content"]):
                    handle = io.BytesIO(content.as_py())
                    yield from _read_archive(path.as_py(), handle, strip_components, 0, 1)

        yield from _arrow_rows(rows())

    members = files.select("path", "content").mapInArrow(expand, _MEMBERS).drop("chunk")
    return _checked(members) if strict else members


def expand_archive_files(
    catalog: DataFrame,
    strip_components: int = 0,
    part_bytes: int = 256 << 20,
    tasks: int | None = None,
    strict: bool = False,
    chunk_bytes: int | None = None,
) -> DataFrame:
    """:func:`expand_archives` for files opened by their path in the tasks.

    ``catalog`` has ``path`` and ``length``. Archives may be larger than memory: only one batch
    of members is held at a time. A large zip file is cut into parts that several tasks read. Of an
    uncompressed tar one task reads the headers, from member to member, and all tasks read the members;
    a compressed one can only be read from front to back. The work is spread over ``tasks`` tasks (as
    many as there are shuffle partitions by default).

    A member has to fit into a row, below 2 GiB. With ``chunk_bytes`` members are cut to rows of so
    many bytes, counted from 0 in a column ``chunk`` behind ``member``.
    """
    # A fixed number: by their size, the few bytes of work would all be joined into one task.
    tasks = tasks or int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    magic = F.substring("head", 258, 5) == F.lit(b"ustar")
    heads = read_heads(catalog, 512, tasks).select("path", magic.alias("plain"))
    known = catalog.select("path", "length").join(heads, "path")

    def expand(batches):
        def rows():
            for batch in batches:
                for row in batch.to_pylist():
                    system, path = file_system(row["path"])
                    with system.open_input_file(path) as file:
                        small = file.size() <= _BATCH_BYTES
                        handle = io.BytesIO(file.read()) if small else file
                        yield from _read_archive(
                            row["path"], handle, strip_components, row["part"], row["parts"], chunk_bytes
                        )

        yield from _arrow_rows(rows())

    parts = F.ceil(F.greatest(F.col("length"), F.lit(1)) / part_bytes)
    work = known.filter(~F.col("plain")).select("path", parts.cast("int").alias("parts")).select(
        "path", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    members = work.repartition(tasks, "path", "part").mapInArrow(expand, _MEMBERS)
    plain = known.filter("plain").select("path").repartition(tasks, "path")
    members = members.unionByName(_tar_ranges(plain, strip_components, tasks, chunk_bytes))
    members = members if chunk_bytes else members.drop("chunk")
    return _checked(members) if strict else members


def _tar_ranges(catalog: DataFrame, strip: int, tasks: int, chunk_bytes: int | None) -> DataFrame:
    """The members of uncompressed tars: an index of their headers, and tasks that read ranges of bytes."""

    def index(batches):
        for batch in batches:
            for path in batch["path"].to_pylist():
                system, name = file_system(path)
                with system.open_input_file(name) as file:
                    rows = list(zip(*_tar_index(path, file)))
                types = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(rows, types)], ["archive", "member", "start", "size", "error"]
                )

    def read(batches):
        def rows():
            opened, file = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["error"]:
                        yield r["archive"], r["member"], 0, None, r["error"]
                        continue
                    if r["archive"] != opened:
                        if file:
                            file.close()
                        system, path = file_system(r["archive"])
                        opened, file = r["archive"], system.open_input_file(path)
                    content = file.read_at(r["length"], r["start"])
                    yield r["archive"], member_target(r["member"], strip), r["chunk"], content, None
            if file:
                file.close()

        yield from _arrow_rows(rows())

    found = catalog.mapInArrow(index, _INDEX)
    size = F.lit(chunk_bytes or _MEMBER_LIMIT).cast("long")
    large = F.lit(chunk_bytes is None) & (F.col("size") > size)
    message = F.concat(F.lit("Member of "), F.col("size"), F.lit(" bytes does not fit a row; set chunk_bytes."))
    found = found.withColumn("error", F.coalesce("error", F.when(large, message)))
    last = F.greatest(F.ceil(F.col("size") / size) - 1, F.lit(0)).cast("int")
    chunks = F.when(F.col("error").isNull(), F.sequence(F.lit(0), last)).otherwise(F.array(F.lit(0)))
    ranges = found.select("*", F.explode(chunks).alias("chunk"))
    begin = F.col("chunk") * size
    ranges = ranges.select(
        "archive", "member", "chunk", "error", (F.col("start") + begin).alias("start"),
        F.least(size, F.col("size") - begin).alias("length"),
    )
    spread = ranges.repartition(tasks, "archive", "start").sortWithinPartitions("archive", "start")
    return spread.mapInArrow(read, _MEMBERS)


def _checked(members: DataFrame) -> DataFrame:
    message = F.concat(F.col("archive"), F.lit(": "), F.col("error"))
    good = F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return members.where(good)


def archive_gate(members: DataFrame) -> DataFrame:
    """The members; the job that uses them fails at the first archive that could not be expanded."""
    return _checked(members)
