"""Text expressions: tokens, estimates, slugs, keys, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stopword list of the lexical index.
STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "if", "then", "else", "for",
    "of", "to", "in", "on", "at", "by", "with", "from", "as", "is",
    "are", "was", "were", "be", "been", "being", "this", "that", "these",
    "those", "it", "its", "we", "you", "they", "he", "she", "i", "me",
    "my", "your", "our", "their", "not", "no", "yes", "do", "does",
    "did", "can", "will", "would", "should", "could", "may", "might",
]

# Replies that carry no information of their own.
TRIVIAL_PROMPTS = [
    "yes", "no", "ok", "okay", "k", "kk", "sure", "yep", "nope",
    "thanks", "ty", "thank you", "thx", "np", "yw",
    "👍", "✅", "🙏", "thanks!",
]

# File types of the two listing profiles.
VAULT_EXTENSIONS = ["md", "txt", "org", "rst"]
DOCUMENT_EXTENSIONS = ["txt", "md", "json", "csv", "xml", "yaml", "yml", "html", "htm", "rst", "adoc", "log"]

VERSIONED_KEY = r"^(?:(.*)/)?v0*([1-9][0-9]*)(?:/.*)?$"


def let(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use``; a lambda that named the
    expression itself would evaluate it again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, at least two bytes, no stopwords."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (F.octet_length(w) >= 2) & ~w.isin(STOPWORDS))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\S+"))


def est_tokens(text: Column) -> Column:
    """Token estimate: 1.3 per word, cut to an integer."""
    return (word_count(text) * F.lit(1.3)).cast("int")


def squeeze(text: Column) -> Column:
    """Strip white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def first_paragraph(text: Column) -> Column:
    """Up to the first blank line, at most 200 characters."""
    return F.left(F.substring_index(text, "\n\n", 1), F.lit(200))


def sentences(text: Column) -> Column:
    """Pieces ending in a full stop that is followed by a space or a newline."""
    return F.split(text, r"(?<=\.)[ \n]")


def slugify(text: Column, length: int = 60) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9-]+", "-")
    trimmed = F.regexp_replace(F.regexp_replace(dashed, "^-+|-+$", ""), "-{2,}", "-")
    return F.regexp_replace(F.left(trimmed, F.lit(length)), "-+$", "")


def display_name(path: Column) -> Column:
    bare = F.regexp_replace(path, r"(?<=.)\.[^./]*$", "")
    spaced = F.translate(F.regexp_replace(bare, "/", " / "), "_-", "  ")
    return F.trim(spaced)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased extension without the dot; empty when there is none."""
    return F.lower(F.regexp_extract(basename(path), r"\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def truncate(text: Column, length: int) -> Column:
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


def snippet(text: Column, length: int = 500) -> Column:
    return F.left(F.trim(F.regexp_replace(text, r"\s+", " ")), F.lit(length))


def is_indexable(path: Column, profile: str = "vault") -> Column:
    """Whether a listing entry is to be indexed under the given profile."""
    ext = extension(path)
    if profile == "vault":
        bare = ~basename(path).contains(".")
        return ~path.contains("/.") & ~path.startswith(".") & (ext.isin(VAULT_EXTENSIONS) | bare)
    if profile == "documents":
        return ~basename(path).startswith(".") & ext.isin(DOCUMENT_EXTENSIONS)
    raise ValueError(f"unknown profile {profile!r}")


def version_of_key(key: Column) -> Column:
    """The number of the last ``/vN`` segment, 0 when the key has none."""
    return F.coalesce(F.regexp_extract(key, VERSIONED_KEY, 2).try_cast("int"), F.lit(0))


def key_prefix(key: Column) -> Column:
    """What stands before the last ``/vN`` segment."""
    return F.regexp_extract(key, VERSIONED_KEY, 1)


def key_hash(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 32)


def chunk_id(source: Column, index: Column) -> Column:
    """Stable UUID-shaped id of a chunk, from its source and position."""
    h = F.sha2(F.concat(source, F.lit(":"), index.cast("string")), 256)
    # The variant bits keep the low two bits of the nibble and set the top one.
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("4"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def normalize_kind(kind: Column) -> Column:
    k = F.lower(F.trim(kind))
    return (
        F.when(k.isin("person", "people", "individual"), "person")
        .when(k.isin("org", "organization", "organisation", "company", "team"), "org")
        .when(k.isin("project", "product", "repo", "repository"), "project")
        .otherwise("concept")
    )


def normalize_rel_type(rel: Column) -> Column:
    snake = F.translate(F.lower(F.trim(rel)), " -", "__")
    return F.regexp_replace(F.regexp_replace(snake, "[^a-z0-9_]", ""), "^_+|_+$", "")


def is_trivial_prompt(prompt: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.trim(prompt)), "[.!?]+$", "")
    return F.coalesce(prompt, F.lit("")).eqNullSafe("") | bare.isin(TRIVIAL_PROMPTS)


def strip_fences(text: Column) -> Column:
    """Remove a surrounding Markdown code fence from a model answer."""
    opened = F.regexp_replace(squeeze(text), r"^```(json)?", "")
    return squeeze(F.regexp_replace(opened, r"```$", ""))


def extract_links(text: Column) -> Column:
    """Local link targets of a text: wiki links first, then Markdown links, each once."""
    wiki = F.transform(
        F.regexp_extract_all(text, F.lit(r"(?s)\[\[(.*?)\]\]"), F.lit(1)),
        lambda m: squeeze(F.substring_index(F.substring_index(m, "|", 1), "#", 1)),
    )
    inline = F.transform(
        F.regexp_extract_all(text, F.lit(r"(?s)\[[^\]]*\]\(([^)]*)\)"), F.lit(1)), lambda m: squeeze(m)
    )

    def local(link):
        return (link != "") & ~link.startswith("http://") & ~link.startswith("https://")

    paths = F.transform(F.filter(inline, local), lambda m: F.substring_index(m, "#", 1))
    return F.array_distinct(F.concat(F.filter(wiki, local), paths))


def any_of(text: Column, needles: list[str]) -> Column:
    """Whether the text contains one of the fixed strings."""
    hit = text.contains(needles[0])
    for n in needles[1:]:
        hit = hit | text.contains(n)
    return hit
