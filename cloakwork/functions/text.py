"""Text functions: normal forms, literal patterns, location of a value, file types, names, categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.patterns import JS_WS, PERCENT_HEADERS, PRICE_LIKE, SWEEP, VENDOR_HEADERS

RADIUS = 45


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: a bound variable isn't copied into the places that name it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(sizes: Column) -> Column:
    """Sums of all earlier entries of an array of whole numbers, the last one being the sum of all: by those of whole
    blocks of about the root of the length, and the rest in one block."""
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def edges(ws: Column) -> Column:
        block = F.ceil(F.sqrt(F.size(ws) + F.lit(1.0))).cast("int")
        sums = F.transform(F.sequence(F.lit(0), F.floor(F.size(ws) / block).cast("int")), lambda b: add(F.slice(ws, F.lit(1), b * block)))
        upto = lambda at: F.transform(F.sequence(F.lit(0), F.size(ws)), lambda i: F.get(at, F.floor(i / block).cast("int")) + add(F.slice(ws, i - i % block + 1, i % block)))
        return let(sums, upto)

    return let(sizes, edges)


def collapse(s: Column) -> Column:
    """Runs of white space become one space; none at the ends. Visible ASCII alone is left as it is, unread by a replacement."""
    return F.when(s.rlike("[^!-~]"), F.trim(F.regexp_replace(s, f"{JS_WS}+", " "))).otherwise(s)


def norm(s: Column) -> Column:
    return F.lower(collapse(s))


def js_trim(s: Column) -> Column:
    """Without white space at the ends, as browsers see it; nothing is sought where both ends are visible ASCII."""
    plain = F.ascii(F.left(s, F.lit(1))).between(33, 126) & F.ascii(F.right(s, F.lit(1))).between(33, 126)
    return F.when(plain, s).otherwise(F.regexp_replace(s, rf"\A{JS_WS}+|{JS_WS}+\z", ""))


def escape(s: Column) -> Column:
    """A value as a literal in a regular expression."""
    return F.regexp_replace(s, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def sought(value: Column) -> Column:
    """Pattern that finds a value in any case, with any white space where it has some."""
    return F.concat(F.lit("(?iu)"), F.regexp_replace(escape(value), f"{JS_WS}+", f"{JS_WS}+".replace("\\", "\\\\")))


def masker(value: Column) -> Column:
    """Pattern for masking: white space may be missing, and all dashes are one."""
    dashes = F.regexp_replace(escape(value), "[-–—]", "[-–—]")  # before white space, whose class has dashes of its own
    return F.concat(F.lit("(?iu)"), F.regexp_replace(dashes, f"{JS_WS}+", f"{JS_WS}*".replace("\\", "\\\\")))


def locate(text: Column, value: Column) -> Column:
    """struct(count, exact, index): how often a value is in the text, its first form there and where (0-based; -1: nowhere).

    An expression is sought only where the value's first digits are in the text, as digits have one form; and a value
    of digits and signs alone is sought as it stands.
    """
    digits = F.regexp_substr(value, F.lit("[0-9]+"))
    there = (F.length(value) > 0) & (digits.isNull() | text.contains(digits))

    def struct(count: Column, exact: Column, first: Column) -> Column:
        return F.struct(count.cast("long").alias("count"), exact.alias("exact"), F.coalesce(F.instr(text, first) - 1, F.lit(-1)).alias("index"))

    def found(all_: Column) -> Column:
        first = F.get(all_, F.lit(0))
        return struct(F.when(all_.isNull(), 0).otherwise(F.size(all_)), F.coalesce(F.regexp_replace(first, f"{JS_WS}+", " "), value), first)

    plain = (F.octet_length(text) - F.octet_length(F.replace(text, value, F.lit("")))) / F.octet_length(value)
    literal = struct(plain, value, value)
    return F.when(there & value.rlike(r"\A[0-9.,%~$€£¥₹+/-]+\z"), literal).otherwise(let(F.when(there, F.regexp_extract_all(text, sought(value), F.lit(0))), found))


def snippet(text: Column, index: Column, length: Column) -> Column:
    """The value at index with its surroundings, marked; empty where index is below 0. Of the text only a window is read."""
    start = F.greatest(F.lit(0), index - RADIUS)
    most = index + length + RADIUS - start
    tight = lambda s: F.regexp_replace(s, f"{JS_WS}+", " ")

    def marked(w: Column) -> Column:
        at = index - start
        return F.trim(F.concat(
            F.when(start > 0, "…").otherwise(""), tight(F.substring(w, F.lit(1), at)), F.lit("«"), tight(F.substring(w, at + 1, length)), F.lit("»"),
            tight(F.substring(w, at + length + 1, most - at - length)), F.when(F.length(w) > most, "…").otherwise(""),
        ))

    return F.when(index < 0, "").otherwise(let(F.substring(text, start + 1, most + 1), marked))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), f"{JS_WS}+", "_")


def sanitize(s: Column) -> Column:
    """Without marks of no width and control characters; line and paragraph separators become line ends."""
    lines = F.regexp_replace(s, "[\\u2028\\u2029]", "\n")
    return F.regexp_replace(lines, "[\\ufeff\\u200b-\\u200d\\ufffd\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")


def strip_fence(s: Column) -> Column:
    """Without a leading line of a code fence and one at the end."""
    return js_trim(F.regexp_replace(F.regexp_replace(s, r"\A```[a-zA-Z]*\n?", ""), r"\n?```\s*\z", ""))


def file_type(name: Column, mime: Column) -> Column:
    """xlsx, csv, pdf, docx or doc by extension or MIME type; null for others."""
    ext, kind = F.lower(F.substring_index(name, ".", -1)), F.lower(F.coalesce(mime, F.lit("")))
    return (
        F.when((ext == "xlsx") | kind.contains("spreadsheetml"), "xlsx").when((ext == "csv") | (kind == "text/csv"), "csv")
        .when((ext == "pdf") | (kind == "application/pdf"), "pdf").when((ext == "docx") | kind.contains("wordprocessingml"), "docx")
        .when((ext == "doc") | (kind == "application/msword"), "doc")
    )


def safe_name(name: Column, kind: Column) -> Column:
    """Name of the masked file: harmless characters, the last extension replaced."""
    clean = F.regexp_replace(name, r"(?i)[^a-z0-9_.\-]", "_")
    return F.concat(F.regexp_replace(clean, r"\.[^.]+\z", ""), F.lit("-masked."), kind)


def route(kind: Column, chars: Column, size: Column, single_pass: int, native: int) -> Column:
    """The masking track of a file by its type and size."""
    sheet, word = kind.isin("xlsx", "csv"), kind.isin("docx", "doc")
    return (
        F.when(sheet & (chars > single_pass), "A-plan").when(sheet & (size > native), "A-csv-text").when(sheet, "A-csv")
        .when(word & (chars > single_pass), "B-detect").when(word, "B-direct").when(kind == "pdf", "C")
    )


def guess_category(value: Column) -> Column:
    return F.when(value.contains("%"), "Percentage").when(value.rlike(PRICE_LIKE), "Price").otherwise("Vendor Name")


def guess_category_from_header(value: Column, header: Column) -> Column:
    h = F.lower(header)
    some = lambda words: F.greatest(*[h.contains(w) for w in words])
    return F.when(some(PERCENT_HEADERS), "Percentage").when(some(VENDOR_HEADERS), "Vendor Name").otherwise(guess_category(value))


def sensitivity(category: Column) -> Column:
    return F.when(category.isin("Vendor Name", "Price"), "high").otherwise("medium")


def category_rank(category: Column) -> Column:
    return F.when(category == "Vendor Name", 0).when(category == "Price", 1).when(category == "Percentage", 2).otherwise(9)


def matches_sweep(cell: Column) -> Column:
    """Whether a cell looks like an amount or a percentage; one without a digit or a dollar can't, and isn't read twice."""
    return cell.rlike("[0-9$]") & collapse(cell).rlike("\\A(?:" + "|".join(SWEEP) + ")\\z")


def column_letters(c: Column) -> Column:
    """Name of a 0-based spreadsheet column, of up to three letters."""
    letter = lambda k: F.chr((65 + k).cast("int"))
    last, rest = letter(c % 26), F.floor(c / 26) - 1
    middle, top = letter(rest % 26), F.floor(rest / 26) - 1
    return F.concat(F.when(top >= 0, letter(top)).otherwise(""), F.when(rest >= 0, middle).otherwise(""), last)


def x_mask(value: Column) -> Column:
    return F.repeat(F.lit("X"), F.greatest(F.lit(1), F.length(value)))


def mask_count(s: Column) -> Column:
    return F.regexp_count(s, F.lit(r"(?i)(?<!\w)XXXX(?!\w)")).cast("long")


def decode_xml(s: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def encode_xml(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def field_id(name: Column, n: Column) -> Column:
    """A detector's own field name as an id; pdf_n where it has none."""
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(name, r"\W+", "_")), F.lit("")), F.concat(F.lit("pdf_"), n.cast("string")))


def event_delta(line: Column) -> Column:
    """Text of a streamed data line of a detector; null for other lines."""
    raw = F.regexp_extract(line, r"\Adata: .*'delta':.*'text': '((?:[^'\\]|\\.)*)'", 1)
    plain = F.replace(F.replace(F.replace(raw, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit("\\'"), F.lit("'"))
    return F.when(raw != "", F.replace(plain, F.lit("\\\\"), F.lit("\\")))
