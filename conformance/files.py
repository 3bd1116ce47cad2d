"""Files: formats, lines, charsets, content, archives."""

import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from conformance import Query, spread_table, table
from tidegate.functions.formats import format_of_content_type, format_of_path, suffix_of_content_type
from tidegate.functions.missing import ORDER_COLUMN
from tidegate.operators.dedupe import drop_duplicates
from tidegate.operators.file_jobs import (
    convert_encoding, decode_text, detect_charset, detect_format, encode_text,
    expand_archive_files, expand_archives, inspect_files,
)
from tidegate.scratch import scratch_path
from tidegate.sources.files import file_catalog, list_files, read_files, write_files
from tidegate.sources.tables import convert, read_table, write_table
from tidegate.sources.text import number_lines, read_lines, write_lines


def _round_trip(name, fmt):
    def build(spark, sf_dir):
        df = table(spark, sf_dir, name)
        path = scratch_path(spark, f"{name}.{fmt}")
        write_table(df, path, fmt)
        return read_table(spark, path, fmt, schema=df.schema)

    return Query(build, f"SELECT * FROM {name}")


def _inferred_csv(spark, sf_dir):
    path = scratch_path(spark, "part-csv")
    write_table(table(spark, sf_dir, "part"), path, "csv")
    return read_table(spark, path, "csv")


def _converted(spark, sf_dir):
    middle, target = scratch_path(spark, "customer-jsonl"), scratch_path(spark, "customer-parquet")
    write_table(table(spark, sf_dir, "customer"), middle, "jsonl")
    convert(spark, middle, target, "jsonl", "parquet")
    return read_table(spark, target, "parquet")


def _encoded_csv(spark, sf_dir):
    df = table(spark, sf_dir, "conversations")
    path = scratch_path(spark, "utf16-csv")
    write_table(df, path, "csv", encoding="utf-16")
    return read_table(spark, path, "csv", schema=df.schema, encoding="utf-16")


def _first_in_file(spark, sf_dir):
    """The first row of each key, by the order of rows in the file."""
    lines = read_table(spark, f"{sf_dir}/lineitem.parquet", row_order=True)
    return drop_duplicates(lines, ["l_suppkey", "l_returnflag"], "first").drop(ORDER_COLUMN)


def _lines(spark, sf_dir):
    path = scratch_path(spark, "document-lines")
    write_lines(table(spark, sf_dir, "documents"), "text", path)
    return read_lines(spark, path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


def _wide_lines(spark, sf_dir):
    """Documents as files of UTF-16, some hundred in a file, read line by line in splits."""
    path = scratch_path(spark, "wide-lines")
    text = F.concat(F.array_join(F.collect_list("text"), "\n"), F.lit("\n"))
    files = table(spark, sf_dir, "documents").groupBy(_group("doc_id", 300).alias("part")).agg(text.alias("text"))
    files = files.select(F.concat("part", F.lit(".txt")).alias("path"), encode_text(F.col("text"), "utf-16").alias("content"))
    write_files(files, path)
    lines = read_lines(spark, path, encoding="utf-16", errors="strict")
    return lines.groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


def _numbered_lines(spark, sf_dir):
    """Within each file, the numbers run from 1 on without a gap and follow the lines."""
    path = scratch_path(spark, "event-lines")
    ordered = table(spark, sf_dir, "events").orderBy("event_id")
    write_lines(ordered, F.format_string("%012d,%s", "event_id", "event_type"), path)
    numbered = number_lines(read_lines(spark, path), read_lines(spark, path, keep_blank=True))
    line, number = F.col("value"), F.col("line_no")
    counts = numbered.groupBy("file").agg(
        F.count("*").alias("n"), F.min(number).alias("low"), F.max(number).alias("high"),
        F.sum(number).alias("total"), F.min_by(line, number).alias("first"), F.min(line).alias("least"),
        F.max_by(line, number).alias("last"), F.max(line).alias("most"),
    )
    n = F.col("n")
    fine = (
        (F.col("low") == 1) & (F.col("high") == n) & (F.col("total") * 2 == n * (n + 1))
        & (F.col("first") == F.col("least")) & (F.col("last") == F.col("most"))
    )
    return counts.agg(F.sum("n").alias("lines"), F.bool_and(fine).alias("in_order"))


def _catalog(spark, sf_dir):
    path = scratch_path(spark, "event-files")
    props = table(spark, sf_dir, "events").select("event_type", F.col("props").alias("value"))
    props.write.partitionBy("event_type").option("compression", "none").text(path)
    files = file_catalog(spark, path, glob="*.txt")
    kind = F.regexp_extract("path", "event_type=([^/]*)/", 1).alias("event_type")
    return files.groupBy(kind, "format").agg(F.sum("length").alias("bytes"))


def _folder_tree(spark, sf_dir):
    """Documents as files of a deep tree, found level by level; every tenth one is empty."""
    path = scratch_path(spark, "tree")
    digits = F.transform(F.split(F.col("doc_id").cast("string"), ""), lambda d: F.concat(F.lit("d"), d))
    docs = table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "lang", F.array_join(digits, "/"), F.concat("doc_id", F.lit(".txt"))).alias("path"),
        F.when(F.col("doc_id") % 10 == 3, "").otherwise(F.col("text")).alias("text"),
    )
    write_files(docs, path, "path", "text")
    inside = F.substring_index(F.col("path"), "/tree-", -1)
    return list_files(spark, path, "*.txt").select(F.regexp_replace(inside, "^[^/]*/", "").alias("file"), "length")


def _contents(spark, sf_dir):
    """Read whole files back as bytes, and count the characters they hold."""
    path = scratch_path(spark, "document-files")
    docs = table(spark, sf_dir, "documents").select("lang", F.col("text").alias("value"))
    docs.write.partitionBy("lang").text(path)
    files = read_files(spark, path, glob="*.txt")
    text = F.length(decode_text(F.col("content"), "utf-8"))
    return files.groupBy(F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang")).agg(
        F.sum(text).alias("characters")
    )


_NAMES = ["csv", "PARQUET", "xls", "Json", "jsonl", "tar.gz", "tar.BZ2", "gz", "pb", "txt", "shp"]
_KNOWN = ["csv", "parquet", "excel", "json", "jsonl", "tar", "tar", "unknown", "gtfs-rt", "text", "shapefile"]


def _paths(spark, sf_dir):
    names = F.array(*map(F.lit, _NAMES))
    path = F.concat(
        F.lit("s3://landing/"), F.col("source"), F.lit("/v1.2/"), F.col("doc_id").cast("string"),
        F.lit("."), F.get(names, (F.col("n_chars") % len(_NAMES)).cast("int")),
    )
    df = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return df.select("doc_id", "path", format_of_path(F.col("path")).alias("format"))


_TYPES = ["text/csv", " Application/JSON ; charset=utf-8", "application/parquet", "text/plain;q=1", "image/png", ""]
_SUFFIXES = [".csv", ".json", ".parquet", ".txt", ".bin", ".bin"]
_TYPE_FORMATS = ["csv", "json", "parquet", "text", "binary", "binary"]


def _content_types(spark, sf_dir):
    types = F.array(*map(F.lit, _TYPES))
    chosen = F.get(types, (F.col("user_id") % len(_TYPES)).cast("int"))
    return table(spark, sf_dir, "events").select(
        "event_id",
        suffix_of_content_type(chosen).alias("suffix"),
        format_of_content_type(chosen).alias("format"),
    )


def _pick_sql(values, key):
    listed = ", ".join(f"'{v}'" for v in values)
    return f"[{listed}][CAST({key} % {len(values)} AS INT) + 1]"


_CHARSETS = ["utf-8", "utf-16", "utf-32", "latin-1", "cp1252", "gb18030"]


def _charset_rows(spark, sf_dir):
    """Documents as files, each in one of several charsets."""
    charsets = F.array(*map(F.lit, _CHARSETS))
    df = spread_table(spark, sf_dir, "documents").withColumn(
        "charset", F.get(charsets, (F.col("n_chars") % len(_CHARSETS)).cast("int"))
    )
    latin = F.col("text").rlike("^[\\x00-\\x7f\\xa0-\\xff]*$")
    limited = F.col("charset").isin("latin-1", "cp1252")
    df = df.withColumn("charset", F.when(limited & ~latin, "utf-8").otherwise(F.col("charset")))
    return df.withColumn("content", encode_text(F.col("text"), F.col("charset")))


def _decoded(spark, sf_dir):
    files = _charset_rows(spark, sf_dir)
    return files.select("doc_id", decode_text(F.col("content"), F.col("charset")).alias("text"))


def _damaged(spark, sf_dir):
    """UTF-8 texts with an invalid byte at both ends."""
    bad = F.concat(F.unhex(F.lit("FF")), F.encode("text", "UTF-8"), F.unhex(F.lit("80")))
    return spread_table(spark, sf_dir, "documents").select("doc_id", decode_text(bad, "utf-8").alias("text"))


def _reencoded(spark, sf_dir):
    files = spread_table(spark, sf_dir, "documents").select(
        "doc_id", encode_text(F.col("text"), "utf-16").alias("content")
    )
    done = convert_encoding(files, target_encoding="utf-8")
    return done.select("doc_id", "source_encoding", F.decode("converted", "UTF-8").alias("text"))


def _detected(spark, sf_dir):
    """Documents in charsets that show by a byte-order mark or by valid UTF-8."""
    charsets = F.array(*map(F.lit, ["utf-8", "utf-16", "utf-32"]))
    chosen = F.get(charsets, (F.col("n_chars") % 3).cast("int"))
    files = spread_table(spark, sf_dir, "documents").withColumn("content", encode_text(F.col("text"), chosen))
    return files.select("doc_id", detect_charset(F.col("content")).alias("found"))


def _sniffed(spark, sf_dir):
    """Every document as a JSON, an XML, a binary, a CSV and an empty file."""
    text, n = F.col("text"), F.col("doc_id").cast("string")
    line = F.concat(n, F.lit(";"), F.col("lang"), F.lit(";"), F.col("source"), F.lit("\n"))
    escaped = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    plain = F.regexp_replace(escaped, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\uffff]", "")
    kinds = {
        "json": F.encode(F.to_json(F.struct("doc_id", "text")), "UTF-8"),
        "xml": F.encode(F.concat(F.lit("<doc><p>"), plain, F.lit("</p></doc>")), "UTF-8"),
        "binary": F.concat(F.encode(text, "UTF-8"), F.unhex(F.lit("C3"))),
        "csv": F.encode(F.concat(F.lit("id;lang;source\n"), F.repeat(line, 12)), "UTF-8"),
        "unknown": F.unhex(F.lit("")),
    }
    rows = [F.struct(F.lit(k).alias("made"), v.alias("content")) for k, v in kinds.items()]
    files = spread_table(spark, sf_dir, "documents").select("doc_id", F.inline(F.array(*rows)))
    return files.select("doc_id", "made", detect_format(F.col("content"), None).alias("found"))


def _packed(batches):
    """Archives of the rows of each batch: zip and tar.gz in turn."""
    for batch in batches:
        for i, (_, part) in enumerate(batch.groupby(batch.index // 50)):
            out = io.BytesIO()
            members = [(f"docs/{r.lang}/{r.doc_id}.txt", r.text.encode()) for r in part.itertuples()]
            if i % 2:
                with tarfile.open(fileobj=out, mode="w:gz") as tar:
                    for name, content in members:
                        info = tarfile.TarInfo(name)
                        info.size = len(content)
                        tar.addfile(info, io.BytesIO(content))
            else:
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                    for name, content in members:
                        archive.writestr(name, content)
            name = f"{part.doc_id.iloc[0]}.{'tar.gz' if i % 2 else 'zip'}"
            yield pd.DataFrame({"path": [name], "content": [out.getvalue()]})


def _archives(spark, sf_dir):
    docs = spread_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return docs.mapInPandas(_packed, "path string, content binary")


def _expanded(spark, sf_dir):
    return _members(expand_archives(_archives(spark, sf_dir), strip_components=1))


def _expanded_files(spark, sf_dir):
    """The archives as files, opened by their path and read in parts."""
    path = scratch_path(spark, "archives")
    write_files(_archives(spark, sf_dir), path)
    members = expand_archive_files(file_catalog(spark, path), strip_components=1, part_bytes=10_000)
    return _members(members)


def _group(ids, number):
    """A group of so many ids: files stay small, and there are more of them for more rows."""
    return F.floor(F.col(ids) / number)


def _json_document(spark, sf_dir):
    """Orders by customer, those of 50 customers as one array document of several lines."""
    path = scratch_path(spark, "orders-json")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    rows = F.sort_array(F.collect_list(F.to_json(F.struct("o_orderkey", "o_custkey", "o_orderpriority"))))
    text = F.concat(F.lit(" \n[\n"), F.array_join(rows, ",\n"), F.lit("\n]"))
    files = orders.groupBy(_group("o_custkey", 50).alias("part")).agg(text.alias("content"))
    write_files(files.select(F.concat("part", F.lit(".json")).alias("path"), "content"), path)
    return read_table(spark, path, "json")


def _quoted_lines(spark, sf_dir):
    """Documents with line ends in their cells, read in splits, by their order in the files."""
    path = scratch_path(spark, "document-cells")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "n_chars")
    write_table(docs.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id"), path, "csv")
    read = read_table(spark, path, "csv", row_order=True)
    first = F.min_by("doc_id", ORDER_COLUMN) == F.min("doc_id")
    in_order = read.groupBy(F.col(ORDER_COLUMN)["file"].alias("file")).agg(first.alias("in_order"))
    return read.join(in_order, F.col(ORDER_COLUMN)["file"] == F.col("file")).select(*docs.columns, "in_order")


def _legacy_cells(spark, sf_dir):
    """Documents in CSV files of a Chinese charset: cells with line ends, no switch of the session."""
    path = scratch_path(spark, "legacy-cells")
    cell = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    row = F.concat_ws(",", F.col("doc_id").cast("string"), cell)
    docs = table(spark, sf_dir, "documents").groupBy(_group("doc_id", 100).alias("part"))
    text = F.concat(F.lit("doc_id,text\r\n"), F.array_join(F.collect_list(row), "\r\n"))
    files = docs.agg(encode_text(text, "gb18030").alias("content"))
    write_files(files.select(F.concat("part", F.lit(".csv")).alias("path"), "content"), path)
    return read_table(spark, path, "csv", schema="doc_id long, text string", encoding="gb18030")


def _large_document(spark, sf_dir):
    """Documents as indented JSON arrays of some megabytes, with objects inside of the records."""
    path = scratch_path(spark, "documents-json")
    inner = F.struct("lang", "source", F.array(F.struct("n_chars")).alias("sizes"))
    one = F.to_json(F.struct("doc_id", "text", inner.alias("about")), {"pretty": "true"})
    docs = table(spark, sf_dir, "documents").groupBy(_group("doc_id", 1000).alias("part"))
    text = F.concat(F.lit("[\n"), F.array_join(F.collect_list(one), ",\n"), F.lit("\n]\n"))
    write_files(docs.agg(text.alias("content")).select(F.concat("part", F.lit(".json")).alias("path"), "content"), path)
    read = read_table(spark, path, "json")
    return read.select("doc_id", "text", "about.lang", "about.source", F.col("about.sizes")[0]["n_chars"].alias("n_chars"))


def _json_kinds(spark, sf_dir):
    """A folder that holds both array documents and files with a record per line."""
    path = scratch_path(spark, "customers-json")
    one = F.to_json(F.struct("c_custkey", "c_name"))
    rows = F.collect_list(one)
    customers = table(spark, sf_dir, "customer").groupBy(_group("c_custkey", 100).alias("part"))
    files = customers.agg(
        F.when(F.first(_group("c_custkey", 100) % 2) == 0, F.concat(F.lit("["), F.array_join(rows, "\n,"), F.lit("]")))
        .otherwise(F.array_join(rows, "\n")).alias("content")
    )
    write_files(files.select(F.concat("part", F.lit(".json")).alias("path"), "content"), path)
    return read_table(spark, path, "json")


def _late_characters(spark, sf_dir):
    """Documents behind more than 10,000 plain characters: no prefix shows their charset."""
    text = F.concat(F.repeat(F.lit("plain "), 1700), F.col("text"), F.lit(" é 日本"))
    files = spread_table(spark, sf_dir, "documents").select("doc_id", F.encode(text, "UTF-8").alias("content"))
    done = convert_encoding(files)
    return done.select("doc_id", "source_encoding", F.substring(F.decode("converted", "UTF-8"), 10_201, 1 << 30).alias("text"))


_LEGACY_TEXTS = {
    "cp932": "顧客の注文は次のとおりです。",
    "euc_jp": "顧客の注文は次のとおりです。",
    "latin-1": "L'été à Genève, où déjà tout est prêt.",
}


def _legacy_charsets(spark, sf_dir):
    """A sentence with each customer's name, in a charset without any mark."""
    names = list(_LEGACY_TEXTS)
    number = (F.col("c_custkey") % len(names)).cast("int")
    text = F.concat(F.col("c_name"), F.lit(" "), F.get(F.array(*map(F.lit, _LEGACY_TEXTS.values())), number))
    files = table(spark, sf_dir, "customer").select(
        "c_custkey", encode_text(text, F.get(F.array(*map(F.lit, names)), number)).alias("content")
    )
    done = convert_encoding(files)
    return done.select("c_custkey", "source_encoding", "text")


def _legacy_sql():
    cases = " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(_LEGACY_TEXTS))
    texts = " ".join(
        "WHEN {} THEN '{}'".format(i, text.replace("'", "''")) for i, text in enumerate(_LEGACY_TEXTS.values())
    )
    number = f"c_custkey % {len(_LEGACY_TEXTS)}"
    return f"""SELECT c_custkey, CASE {number} {cases} END AS source_encoding,
        c_name || ' ' || CASE {number} {texts} END AS text FROM customer"""


#: Sentences that the models of the charsets were not made of.
_SINGLE_BYTE = {
    "cp1251": "Вчера вечером наша соседка рассказала интересную историю о путешествии через горы.",
    "koi8-r": "Никто не знал, где находится ключ от этой двери, но мы решили подождать до утра.",
    "cp866": "Ответ на письмо пришёл только через две недели, когда погода стала совсем тёплой.",
    "iso8859-7": "Χθες το βράδυ η γειτόνισσά μας διηγήθηκε μια ενδιαφέρουσα ιστορία για ένα ταξίδι.",
    "iso8859-2": "Včera večer nám naše sousedka vyprávěla zajímavý příběh o cestě přes vysoké hory.",
    "cp1250": "Nikt nie wiedział, gdzie leży klucz, więc poszliśmy jeszcze wcześniej spać, śniąc o lecie.",
    "iso8859-9": "Dün akşam komşumuz dağlardan geçen uzun bir yolculuk hakkında ilginç şeyler anlattı.",
    "latin-1": "Gestern Abend erzählte unsere Nachbarin eine schöne Geschichte über große Wälder.",
    "big5": "昨天晚上我們的鄰居講了一個關於穿越山脈旅行的有趣故事。",
    "gb18030": "昨天晚上我们的邻居讲了一个关于穿越山脉旅行的有趣故事。",
}


def _single_byte(spark, sf_dir):
    """Orders as files, each with a sentence in a charset that nothing marks."""
    names = list(_SINGLE_BYTE)
    number = (F.col("o_orderkey") % len(names)).cast("int")
    sentence = F.get(F.array(*map(F.lit, _SINGLE_BYTE.values())), number)
    text = F.concat_ws(";", F.col("o_orderkey").cast("string"), "o_orderpriority", sentence)
    files = spread_table(spark, sf_dir, "orders").select(
        "o_orderkey", encode_text(text, F.get(F.array(*map(F.lit, names)), number)).alias("content")
    )
    return convert_encoding(files).select("o_orderkey", "source_encoding", "text")


def _single_byte_sql():
    names = ", ".join(f"'{name}'" for name in _SINGLE_BYTE)
    texts = ", ".join(f"'{text}'" for text in _SINGLE_BYTE.values())
    number = f"CAST(o_orderkey % {len(_SINGLE_BYTE)} AS INT) + 1"
    return f"""SELECT o_orderkey, [{names}][{number}] AS source_encoding,
        o_orderkey || ';' || o_orderpriority || ';' || [{texts}][{number}] AS text FROM orders"""


def _page_tars(spark, sf_dir, path, mode):
    """Pages as tar files of a hundred pages, whose names don't say so."""

    def packed(pages):
        buffer = io.BytesIO()
        with tarfile.open(fileobj=buffer, mode=mode) as archive:
            for page, html in zip(pages["page_id"], pages["html"]):
                raw = html.encode()
                info = tarfile.TarInfo(f"{page}.html")
                info.size = len(raw)
                archive.addfile(info, io.BytesIO(raw))
        return pd.DataFrame({"path": [pages["archive"].iloc[0]], "content": [buffer.getvalue()]})

    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("pages"), _group("page_id", 100), F.lit(".dat")).alias("archive"), "page_id", "html"
    )
    write_files(pages.groupBy("archive").applyInPandas(packed, "path string, content binary"), path)


def _renamed_tars(spark, sf_dir):
    """Compressed tars, far larger than a part."""
    path = scratch_path(spark, "renamed-tars")
    _page_tars(spark, sf_dir, path, "w:bz2")
    members = expand_archive_files(file_catalog(spark, path), part_bytes=1000, strict=True)
    page = F.regexp_extract("member", r"(\d+)\.html$", 1).cast("long").alias("page_id")
    return members.select(page, F.decode("content", "UTF-8").alias("html"))


def _plain_tars(spark, sf_dir):
    """Uncompressed tars, read in ranges of bytes; members come in chunks and are put together."""
    path = scratch_path(spark, "plain-tars")
    _page_tars(spark, sf_dir, path, "w")
    chunks = expand_archive_files(file_catalog(spark, path), strict=True, chunk_bytes=1500)
    page = F.regexp_extract("member", r"(\d+)\.html$", 1).cast("long").alias("page_id")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "content"))), lambda x: F.hex(x["content"]))
    pages = chunks.groupBy(page).agg(F.unhex(F.array_join(parts, "")).alias("content"))
    return pages.select("page_id", F.decode("content", "UTF-8").alias("html"))


def _inspected(spark, sf_dir):
    """Pages as JSON files, most of them longer than the bytes that are looked at."""
    path = scratch_path(spark, "page-json")
    pages = table(spark, sf_dir, "pages")
    text = F.to_json(F.struct("page_id", "url", F.col("html"))).alias("content")
    write_files(pages.select(F.concat("page_id", F.lit(".json")).alias("path"), text), path)
    found = inspect_files(file_catalog(spark, path))
    page = F.regexp_extract("path", r"(\d+)\.json$", 1).cast("long").alias("page_id")
    return found.select(page, "detected_format")


def _written_files(spark, sf_dir):
    """One file per page, read back as bytes."""
    path = scratch_path(spark, "pages")
    pages = table(spark, sf_dir, "pages").select(
        F.format_string("%d/%d.html", F.col("page_id") % 10, "page_id").alias("path"), "html"
    )
    write_files(pages, path, "path", "html")
    return read_files(spark, path, glob="*.html").select(
        F.regexp_extract("path", r"(\d+)\.html$", 1).cast("long").alias("page_id"),
        F.md5("content").alias("digest"),
        "length",
    )


def _members(members):
    return members.select(
        "member", F.decode("content", "UTF-8").alias("text"), F.col("error").isNull().alias("fine")
    )


MEMBERS_SQL = "SELECT lang || '/' || doc_id || '.txt' AS member, text, true AS fine FROM documents"

QUERIES = {
    "roundtrip_csv": _round_trip("documents", "csv"),
    "roundtrip_json": _round_trip("orders", "json"),
    "roundtrip_jsonl": _round_trip("conversations", "jsonl"),
    "roundtrip_parquet": _round_trip("lineitem", "parquet"),
    "roundtrip_csv_times": _round_trip("events", "csv"),
    "csv_inferred": Query(_inferred_csv, "SELECT * REPLACE (CAST(p_size AS BIGINT) AS p_size) FROM part"),
    "csv_utf16": Query(_encoded_csv, "SELECT * FROM conversations"),
    "convert_jsonl_parquet": Query(_converted, "SELECT * REPLACE (CAST(c_nationkey AS BIGINT) AS c_nationkey) FROM customer"),
    "dedupe_file_order": Query(
        _first_in_file,
        """SELECT * EXCLUDE (pos, n) FROM (
               SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY pos) AS n
               FROM (SELECT *, row_number() OVER () AS pos FROM lineitem)) WHERE n = 1""",
    ),
    "read_lines": Query(
        _lines,
        """SELECT line, count(*) AS n FROM
               (SELECT unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS line FROM documents)
           WHERE trim(line, chr(9) || chr(32) || chr(11) || chr(12)) <> '' GROUP BY line""",
    ),
    "read_lines_utf16": Query(
        _wide_lines,
        """SELECT line, count(*) AS n FROM
               (SELECT unnest(string_split_regex(text, '\\r?\\n')) AS line FROM documents)
           WHERE trim(line, chr(9) || chr(32) || chr(11) || chr(12) || chr(13)) <> '' GROUP BY line""",
    ),
    "number_lines": Query(
        _numbered_lines, "SELECT count(*) AS lines, true AS in_order FROM events"
    ),
    "file_catalog": Query(
        _catalog,
        """SELECT event_type, 'text' AS format, CAST(sum(strlen(props) + 1) AS BIGINT) AS bytes
           FROM events GROUP BY event_type""",
    ),
    "list_folder_tree": Query(
        _folder_tree,
        """SELECT lang || '/' || array_to_string(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                   lambda d: 'd' || d), '/') || '/' || doc_id || '.txt' AS file,
               CASE WHEN doc_id % 10 = 3 THEN 0 ELSE strlen(text) END AS length FROM documents""",
    ),
    "file_contents": Query(
        _contents, "SELECT lang, CAST(sum(length(text) + 1) AS BIGINT) AS characters FROM documents GROUP BY lang"
    ),
    "format_of_path": Query(
        _paths,
        f"""SELECT doc_id, 's3://landing/' || source || '/v1.2/' || doc_id || '.' || {_pick_sql(_NAMES, "n_chars")} AS path,
                {_pick_sql(_KNOWN, "n_chars")} AS format FROM documents""",
    ),
    "content_type_format": Query(
        _content_types,
        f"""SELECT event_id, {_pick_sql(_SUFFIXES, "user_id")} AS suffix,
                {_pick_sql(_TYPE_FORMATS, "user_id")} AS format FROM events""",
    ),
    "decode_text": Query(_decoded, "SELECT doc_id, text FROM documents"),
    "decode_damaged_text": Query(
        _damaged, "SELECT doc_id, chr(65533) || text || chr(65533) AS text FROM documents"
    ),
    "convert_encoding": Query(
        _reencoded,
        """SELECT doc_id, 'utf-16' AS source_encoding,
               replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS text FROM documents""",
    ),
    "detect_charset": Query(
        _detected,
        f"""SELECT doc_id, CASE n_chars % 3 WHEN 1 THEN 'utf-16' WHEN 2 THEN 'utf-32'
                ELSE CASE WHEN strlen(text) = length(text) THEN 'ascii' ELSE 'utf-8' END END AS found
            FROM documents""",
    ),
    "sniff_format": Query(
        _sniffed,
        """SELECT doc_id, made, made AS found FROM documents,
               (SELECT unnest(['json', 'xml', 'binary', 'csv', 'unknown']) AS made)""",
    ),
    "expand_archives": Query(_expanded, MEMBERS_SQL),
    "expand_archive_files": Query(_expanded_files, MEMBERS_SQL),
    "read_json_document": Query(
        _json_document, "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders"
    ),
    "csv_quoted_lines": Query(_quoted_lines, "SELECT doc_id, text, source, n_chars, true AS in_order FROM documents"),
    "csv_legacy_charset": Query(_legacy_cells, "SELECT doc_id, text FROM documents"),
    "json_large_document": Query(_large_document, "SELECT doc_id, text, lang, source, n_chars FROM documents"),
    "json_kinds_by_content": Query(_json_kinds, "SELECT c_custkey, c_name FROM customer"),
    "convert_encoding_default": Query(
        _late_characters, "SELECT doc_id, 'utf-8' AS source_encoding, text || ' é 日本' AS text FROM documents"
    ),
    "detect_legacy_charset": Query(_legacy_charsets, _legacy_sql()),
    "detect_single_byte_charset": Query(_single_byte, _single_byte_sql()),
    "expand_plain_tars": Query(_plain_tars, "SELECT page_id, html FROM pages"),
    "expand_renamed_tars": Query(_renamed_tars, "SELECT page_id, html FROM pages"),
    "inspect_files": Query(_inspected, "SELECT page_id, 'json' AS detected_format FROM pages"),
    "write_files": Query(
        _written_files, "SELECT page_id, md5(html) AS digest, strlen(html) AS length FROM pages"
    ),
}
