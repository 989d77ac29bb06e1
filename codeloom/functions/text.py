"""Text functions as column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from codeloom.functions.words import STOP_WORDS

TOKEN = r"[A-Za-z_$][A-Za-z0-9_$]*|[0-9]+(?:\.[0-9]+)?|==|&&|\|\||<=|>=|[^\sA-Za-z0-9_$]"


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")


def camel_marked(text: Column) -> Column:
    marked = F.regexp_replace(text, "(.)([A-Z][a-z]+)", "$1#$2")
    return F.regexp_replace(marked, "([a-z0-9])([A-Z])", "$1#$2")


def split_camel(text: Column) -> Column:
    return F.split(camel_marked(text), "#")


def stop_words() -> Column:
    return F.array(*[F.lit(w) for w in STOP_WORDS])


def without_stop_words(tokens: Column) -> Column:
    return F.array_except(tokens, stop_words())


def not_stop_word(token: Column) -> Column:
    return ~token.isin(*STOP_WORDS)


def name_words(text: Column) -> Column:
    """Words of an identifier or comment: ASCII letters only, camel split, 2 to 9 letters."""
    ascii_only = F.regexp_replace(text, r"[^\x00-\x7F]", "")
    letters = F.regexp_replace(F.regexp_replace(ascii_only, "[0-9]+", ""), "[^a-zA-Z]+", "#")
    parts = F.transform(F.split(camel_marked(letters), "#"), F.lower)
    return F.filter(parts, lambda w: F.length(w).between(2, 9) & not_stop_word(w))


def method_base(name: Column) -> Column:
    return F.substring_index(name, "@", 1)


def reconstruct_camel(parts: Column) -> Column:
    """First word as it is, the others with a capital."""
    first = F.coalesce(F.get(parts, F.lit(0)), F.lit(""))
    rest = F.transform(F.slice(parts, 2, 1 << 30), F.initcap)
    return F.concat(first, F.array_join(rest, ""))


def drop_doc_comments(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\n", ""), r"(?s)/\*\*(.*?)\*/", "")


def drop_doc_comments_and_annotations(text: Column) -> Column:
    """As above; also words starting with ``@`` go and white space collapses."""
    kept = F.filter(F.split(drop_doc_comments(text), r"\s+"), lambda w: (w != "") & ~w.startswith("@"))
    return F.array_join(kept, " ")


def header(text: Column) -> Column:
    """Text without its body: the first ``{`` to the last ``}``, or to the end if none closes."""
    plain = drop_doc_comments_and_annotations(text)
    closed = plain.rlike(r"(?s)\{.*\}")
    return F.when(closed, F.regexp_replace(plain, r"(?s)\{.*\}", "")).otherwise(
        F.regexp_replace(plain, r"(?s)\{.*", "")
    )


def code_tokens(text: Column) -> Column:
    spaced = F.replace(F.replace(text, F.lit("."), F.lit(" . ")), F.lit("="), F.lit(" = "))
    for apart, joined in (("= =", "=="), ("& &", "&&"), ("| |", "||"), ("< =", "<="), ("> =", ">=")):
        spaced = F.replace(spaced, F.lit(apart), F.lit(joined))
    return F.regexp_extract_all(spaced, F.lit(TOKEN), F.lit(0))


def context_text(class_name: Column, fields: Column, headers: Column, doc: Column, own_header: Column) -> Column:
    return F.concat_ws(" ", class_name, fields, headers, F.coalesce(doc, F.lit(" ")), own_header)


def prune_comments(code: Column) -> Column:
    """Drop lines that start with ``//``."""
    kept = F.filter(F.split(code, "\r\n|\r|\n"), lambda line: ~line.startswith("//"))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def comment_block(text: Column) -> Column:
    return F.concat(F.array_join(F.transform(F.split(text, "\n"), lambda l: F.concat(F.lit("// "), l)), "\n"), F.lit("\n"))


def doc_summary(doc: Column) -> Column:
    """First sentence, without tags, split on punctuation and case; null for to-do notes."""
    has_sentence = doc.rlike(r"^(.*?)\.\W.*$") & ~doc.contains("\n")
    sentence = F.when(has_sentence, F.regexp_extract(doc, r"^(.*?)\.\W.*$", 1)).otherwise(doc)
    untagged = F.regexp_replace(sentence, "<[^>]*>", "")
    spaced = F.regexp_replace(untagged, r"[!-/:-@\[-`{-~\s]+", " ")
    for pattern in (r"(\p{Lu})(\p{Lu}\p{Ll})", r"(\p{Ll})(\p{Lu})", r"(\p{L})(\p{N})", r"(\p{N})(\p{L})"):
        spaced = F.regexp_replace(spaced, pattern, "$1 $2")
    return F.when(sentence.rlike("TODO|FIXME|NOTE|HACK|XXX"), F.lit(None)).otherwise(F.lower(spaced))


def truncate_two_decimals(x: Column) -> Column:
    return (x * 100).cast("bigint") / F.lit(100.0)


def pad(array: Column, width: int, filler: Column | None = None) -> Column:
    """Cut or fill to a fixed width; 0 fills unless told otherwise."""
    filler = F.lit(0) if filler is None else filler
    return F.slice(F.concat(array, F.array_repeat(filler, width)), 1, width)
