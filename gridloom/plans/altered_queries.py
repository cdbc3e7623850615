"""Queries over texts that are altered on the way in, so that what an operator undoes is known.

The given tables hold no full-width forms, carriage returns, invalid bytes, indents or blank ends. These queries put
them in, at places drawn from the seed, and must give what the plain texts give.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions import random as rnd
from gridloom.functions import text as tx
from gridloom.operators import manifest, profile
from gridloom.operators.indexing import with_dense_index
from gridloom.operators.normalize import clean_text, normalize_grid
from gridloom.plans import flows
from gridloom.plans.registry import REGISTRY, csv, query, sql_uniform, table
from gridloom.plans.text_queries import (
    DOCS,
    GRIDS,
    HEIGHT,
    INDEXED,
    MANIFEST,
    MANIFEST_COLUMNS,
    ROOT,
    SEED,
    TOKENS,
    H,
    W,
    dims_top5,
    documents,
    manifest_rows,
    sql_clean,
)
from gridloom.sources.manifest import read_manifest, write_manifest
from gridloom.sources.texts import read_corpus, write_corpus
from gridloom.storage import scratch_path

ASCII = "".join(map(chr, range(0x21, 0x7F)))
WIDE = "".join("\u2013" if c == "-" else chr(ord(c) + 0xFEE0) for c in ASCII)  # full-width forms; an en dash for the hyphen
BOUNDARIES = ["\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
MOST_INDENT, MOST_BLANK = 7, 4


def drawn(n: int, what: str, *keys: Column) -> Column:
    """An integer in [0, n) for the keys."""
    return F.floor(rnd.uniform(SEED, what, *keys) * n).cast("int")


def sql_drawn(n: int | str, what: str, *keys: str) -> str:
    return f"floor({sql_uniform(repr(str(SEED)), repr(what), *keys)} * {n})::int"


@query(f"WITH {GRIDS} SELECT doc_id, grid FROM grids")
def grid_normalize_wide(spark, sf_dir):
    """Every printable character in its full-width form."""
    wide = documents(spark, sf_dir).withColumn("text", F.translate("text", ASCII + " ", WIDE + "\u3000"))
    return normalize_grid(wide, "text", "grid", W, H).select("doc_id", "grid")


@query(f"WITH {GRIDS} SELECT doc_id, grid FROM grids")
def grid_normalize_crlf(spark, sf_dir):
    """Lines that end in a carriage return and a line feed."""
    ended = documents(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\r\n")))
    return normalize_grid(ended, "text", "grid", W, H).select("doc_id", "grid")


@query(f"""WITH placed AS (SELECT doc_id, text, {sql_drawn("(length(text) + 1)", "cut", "doc_id")} AS place FROM documents),
broken AS (SELECT doc_id, substr(text, 1, place) || chr(10) || substr(text, place + 1) AS t FROM placed)
SELECT doc_id, length(t)::bigint AS n_chars, md5(t) AS digest FROM broken""")
def text_scan_damaged(spark, sf_dir):
    """Bytes with CR LF line ends, and an invalid byte and a lone CR at a drawn place."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    at = F.floor(rnd.uniform(SEED, "cut", F.col("doc_id")) * (F.char_length("text") + 1)).cast("int")
    sides = (F.substring("text", F.lit(1), at), F.substring("text", at + 1, F.char_length("text")))
    left, right = (F.encode(F.replace(s, F.lit("\n"), F.lit("\r\n")), "UTF-8") for s in sides)
    damage = F.unhex(F.lit("FF0D"))
    content = F.concat(left, damage, right).alias("content")
    read = docs.select("doc_id", content).select("doc_id", tx.decode_text(F.col("content")).alias("t"))
    return read.select("doc_id", F.char_length("t").cast("bigint").alias("n_chars"), F.md5("t").alias("digest"))


@query(f"""WITH cleaned AS (SELECT conv_id, turn, string_split({sql_clean("text")}, chr(10)) AS plain FROM conversations),
indented AS (SELECT conv_id, turn, list_transform(range(1, len(plain) + 1), lambda i:
  repeat(' ', {sql_drawn(MOST_INDENT, "indent", "conv_id", "turn", "i - 1")}) || plain[i]) AS lines FROM cleaned),
led AS (SELECT *, coalesce(list_min(list_transform(list_filter(lines, lambda l: trim(l, ' ') <> ''),
  lambda l: length(l) - length(ltrim(l, ' ')))), 0) AS lead FROM indented)
SELECT conv_id, turn, rpad(array_to_string(list_transform(lines[1:{H}],
  lambda l: rpad(substr(l, lead + 1), {W}, ' ')), ''), {W * H}, ' ') AS grid FROM led""")
def grid_normalize_indented(spark, sf_dir):
    """Each line of a turn behind a drawn indent."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    moved = F.transform(
        F.split("text", "\n", -1),
        lambda line, i: F.concat(F.repeat(F.lit(" "), drawn(MOST_INDENT, "indent", F.col("conv_id"), F.col("turn"), i)), line),
    )
    rows = turns.withColumn("text", F.array_join(moved, "\n"))
    return normalize_grid(rows, "text", "grid", W, H, shift_left=True).select("conv_id", "turn", "grid")


@query(f"""WITH cleaned AS (SELECT page_id, {sql_clean("html")} AS c FROM pages),
cut AS (SELECT page_id, CASE WHEN trim(c, ' ' || chr(10)) = '' THEN '' ELSE regexp_replace(c, '(\\n *)+$', '') END AS t FROM cleaned)
SELECT page_id, CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + 1 END::int AS n_lines,
  md5(t) AS digest FROM cut""")
def trimmed_lines_padded(spark, sf_dir):
    """Pages with drawn blank lines at the end; blanks at the end of the last line itself stay."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    blank = F.concat(F.lit("\n"), F.repeat(F.lit(" "), drawn(3, "width", F.col("page_id"))))
    padded = pages.withColumn("html", F.concat("html", F.repeat(blank, drawn(MOST_BLANK, "blank", F.col("page_id")) + 1)))
    lines = clean_text(padded, "html", "t").select("page_id", tx.trimmed_lines(F.col("t")).alias("lines"))
    return lines.select("page_id", F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("digest"))


@query(REGISTRY[dims_top5.__name__].sql)
def dims_top5_boundaries(spark, sf_dir):
    """Every line boundary that there is, one kind per document."""
    train = documents(spark, sf_dir).filter(F.col("split") == "train")
    kinds = F.array(*map(F.lit, BOUNDARIES))
    kind = F.get(kinds, drawn(len(BOUNDARIES), "boundary", F.col("doc_id")))
    return profile.dimension_histogram(train.withColumn("text", F.replace("text", F.lit("\n"), kind)), "text", "doc_id", 5)


@query(f"SELECT doc_id, {HEIGHT} AS height FROM documents")
def text_heights_padded(spark, sf_dir):
    """Newlines at both ends and doubled ones within do not make or lose rows at the ends."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ends = [F.repeat(F.lit("\n"), drawn(MOST_BLANK, what, F.col("doc_id"))) for what in ("top", "bottom")]
    return docs.select("doc_id", tx.text_height(F.concat(ends[0], "text", ends[1])).alias("height"))


@query(f"WITH {DOCS} SELECT split, 2 * count(*) AS n_appended, count(*) AS n_replaced FROM docs GROUP BY split")
def corpus_appends(spark, sf_dir):
    """A corpus written twice, then overwritten once."""
    rows = documents(spark, sf_dir)
    twice, once = scratch_path(spark, "appended"), scratch_path(spark, "replaced")
    for path in (twice, once):
        write_corpus(rows, path)
        write_corpus(rows, path)
    write_corpus(rows, once, overwrite=True)
    counts = [
        profile.split_counts(read_corpus(spark, path, rows.schema)).withColumnRenamed("n", name)
        for path, name in ((twice, "n_appended"), (once, "n_replaced"))
    ]
    return counts[0].join(counts[1], "split")


@query(f"WITH {MANIFEST} SELECT {MANIFEST_COLUMNS} FROM manifest")
def manifest_loose_lines(spark, sf_dir):
    """Manifest lines with quoted numbers, and empty and blank lines between them."""
    rows = manifest_rows(spark, sf_dir)
    numbers = {c: F.col(c).cast("string") for c in ("label", "ascii_width", "ascii_height")}
    line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    path = scratch_path(spark, "lines")
    loose = rows.withColumns(numbers).select(F.explode(F.array(line, F.lit(""), F.lit("  "))).alias("value"))
    loose.write.text(path)
    return read_manifest(spark, path)


@query(f"""WITH {TOKENS}, numbered AS (SELECT *, {INDEXED} AS idx FROM tokens)
SELECT split || '-' || lpad(idx::varchar, greatest(6, length(idx::varchar))::int, '0') AS id, split,
  array_to_string(ids, ',') AS ids_csv FROM numbered""")
def dataset_load(spark, sf_dir):
    """Manifest lines and the texts that they name, to encoded splits in one call."""
    rows = manifest_rows(spark, sf_dir)
    path = scratch_path(spark, "manifest")
    write_manifest(rows, path)
    named = with_dense_index(documents(spark, sf_dir), "doc_id", ["split"])
    uid = manifest.record_id(F.col("split"), F.col("idx"))
    texts = named.select(F.concat(F.lit("file:"), manifest.text_path(ROOT, F.col("split"), uid)).alias("path"), "text")
    encoded, _ = flows.load_dataset(spark, path, texts, W, H)
    return encoded.select("id", "split", csv(F.col("ids")).alias("ids_csv"))
