"""Scalar functions on names, paths, links and digests, as column expressions.

All take and give columns, are null for null input unless stated, and stay in
the JVM, so they run inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits of any script, and the underscore, make up a token.
TOKEN_BREAK = r"[^\p{IsAlphabetic}\p{N}_]+"
CAMEL_BREAK = r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})|_"
TERM_BYTES = 256


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- digests and buckets -------------------------------------------------------------------------


def content_digest(c: Column | str) -> Column:
    """``sha256:`` and the hex digest of a string or binary."""
    return F.concat(F.lit("sha256:"), F.sha2(col(c), 256))


def object_digest(domain: str, schema: Column | str, content: Column | str) -> Column:
    """Digest of content under a schema: the same bytes under two schemas differ."""
    head = F.concat(F.encode(F.concat(F.lit(domain), col(schema)), "UTF-8"), F.unhex(F.lit("00")))
    return content_digest(F.concat(head, col(content).cast("binary")))


def term_bucket(c: Column | str) -> Column:
    """First byte of the SHA-256 of a term, as two hex digits."""
    return F.substring(F.sha2(col(c), 256), 1, 2)


def key_bucket(c: Column | str, buckets: int = 64) -> Column:
    """First byte of the SHA-256 of a key modulo the number of buckets."""
    return F.pmod(F.conv(term_bucket(c), 16, 10).cast("int"), F.lit(buckets))


def semantic_key(c: Column | str) -> Column:
    """A fact key without a closing digest of 64 lower-case hex digits."""
    return F.regexp_replace(col(c), ":[0-9a-f]{64}$", "")


# --- terms ---------------------------------------------------------------------------------------


def _tail(token: Column) -> Column:
    """A token above the limit loses what was read each time it grows past it; its tail stays."""
    grow = lambda acc, ch: F.when(F.octet_length(F.concat(acc, ch)) > TERM_BYTES, F.lit("")).otherwise(F.concat(acc, ch))
    return F.when(F.octet_length(token) <= TERM_BYTES, token).otherwise(F.aggregate(F.split(token, ""), F.lit(""), grow))


def normal_terms(values: Column | str) -> Column:
    """Sorted distinct lower-case tokens of an array of strings, two bytes or longer."""
    tokens = F.flatten(F.transform(F.array_compact(col(values)), lambda v: F.split(F.lower(v), TOKEN_BREAK)))
    tokens = F.transform(tokens, _tail)
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: F.octet_length(t) >= 2)))


def identifier_parts(values: Column | str) -> Column:
    """Sorted distinct lower-case parts of camel-case and snake-case tokens; tokens above the limit give none."""
    tokens = F.flatten(F.transform(F.array_compact(col(values)), lambda v: F.split(v, TOKEN_BREAK)))
    tokens = F.filter(tokens, lambda t: F.octet_length(t) <= TERM_BYTES)
    parts = F.flatten(F.transform(tokens, lambda t: F.transform(F.split(t, CAMEL_BREAK), lambda p: F.lower(p))))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda p: F.octet_length(p).between(2, TERM_BYTES))))


def index_terms(values: Column | str) -> Column:
    """Terms that a text is found by: its tokens and the parts of its identifiers."""
    return F.array_sort(F.array_union(normal_terms(values), identifier_parts(values)))


def query_alias(term: Column | str) -> Column:
    """A query term without underscores, where that differs and has two bytes or more; else null."""
    joined = F.replace(col(term), F.lit("_"), F.lit(""))
    return F.when(F.contains(col(term), F.lit("_")) & (F.octet_length(joined) >= 2), joined)


def plain_name(c: Column | str) -> Column:
    """Lower case without underscores."""
    return F.replace(F.lower(col(c)), F.lit("_"), F.lit(""))


def occurrences(text: Column, term: Column) -> Column:
    """How often a term occurs without overlap."""
    return F.when(F.length(term) == 0, F.lit(0)).otherwise(((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("int"))


# --- paths and routes ----------------------------------------------------------------------------


def path_key(path: Column | str) -> Column:
    """A URL template with its variables made anonymous; null for what is no plain template."""
    parts = F.split(col(path), "/", -1)
    keyed = F.transform(parts, lambda p: F.when(p.rlike(r"^\{[A-Za-z0-9_]+\}$"), F.lit("{}")).otherwise(p))
    odd = F.exists(parts, lambda p: ~p.rlike(r"^\{[A-Za-z0-9_]+\}$") & p.rlike(r"[{}*?:#$%\\]"))
    return F.when(F.startswith(col(path), F.lit("/")) & ~odd, F.array_join(keyed, "/"))


def join_path(parent: Column | str, child: Column | str) -> Column:
    """Class and method path with one slash between; null with placeholders or wildcards left in the parent."""
    p, c = col(parent), col(child)
    base = F.when(F.length(c) > 0, F.regexp_replace(p, r"/\*$", "")).otherwise(p)
    rooted = lambda x: F.when(F.startswith(x, F.lit("/")), x).otherwise(F.concat(F.lit("/"), x))
    both = F.concat(F.regexp_replace(rooted(base), "/+$", ""), F.lit("/"), F.regexp_replace(c, "^/+", ""))
    joined = F.when((F.length(base) == 0) & (F.length(c) == 0), F.lit("")).when(F.length(base) == 0, rooted(c)).when(F.length(c) == 0, rooted(base)).otherwise(both)
    return F.when(~F.concat(p, F.lit("\n"), c).rlike(r"[$#]\{") & ~base.rlike(r"[*?]"), joined)


def join_template(controller: Column | str, action: Column | str) -> Column:
    """Route templates of controller and action; an action from the root stands alone; null if both are null."""
    k, a = col(controller), col(action)
    clean = lambda x: F.regexp_replace(F.regexp_replace(x, "^(?:~/)*/*", ""), "/+$", "")
    both = F.array_join(F.filter(F.array(clean(k), clean(a)), lambda x: F.length(x) > 0), "/")
    return F.when(a.rlike("^~?/"), clean(a)).when(k.isNotNull() & a.isNotNull(), both).otherwise(F.coalesce(clean(k), clean(a)))


def fill_template(template: Column | str, controller: Column | str, action: Column | str, area: Column | str) -> Column:
    """``[controller]``, ``[action]`` and ``[area]`` replaced, doubled brackets kept as one; null for other tokens or a missing area."""
    t = F.replace(F.replace(col(template), F.lit("[["), F.lit("\u0001")), F.lit("]]"), F.lit("\u0002"))
    for name, value in (("controller", col(controller)), ("action", col(action)), ("area", col(area))):
        here = t.rlike(rf"(?i)\[{name}(?:\]|$)")
        quoted = F.regexp_replace(value, r"([\\$])", r"\\$1")
        t = F.when(~here, t).otherwise(F.regexp_replace(t, F.lit(rf"(?i)\[{name}(?:\]|$)"), quoted))
    done = F.replace(F.replace(t, F.lit("\u0001"), F.lit("[")), F.lit("\u0002"), F.lit("]"))
    return F.when(~t.rlike(r"[\[\]]"), F.concat(F.lit("/"), done))


# --- links ---------------------------------------------------------------------------------------


def web_base(url: Column | str) -> Column:
    """A repository address fit for links: https, a host, a path, no credentials, query or fragment; else null."""
    u = col(url)
    fits = u.rlike(r"^https://[A-Za-z0-9.-]+(:\d{1,5})?/[^?#@\p{Cntrl}\s]*[^?#@\p{Cntrl}\s/]/*$") & ~u.rlike(r"/\.{1,2}(/|$)")
    return F.when(fits, F.regexp_replace(u, "/+$", ""))


def permalink(provider: Column | str, base: Column | str, revision: Column | str, file: Column | str, start: Column | str, end: Column | str) -> Column:
    """A link to lines of a file at a full commit; null for anything less."""
    ok = col(revision).rlike("^([0-9a-fA-F]{40}|[0-9a-fA-F]{64})$") & (col(start) > 0) & (col(end) >= col(start)) & ~col(file).rlike(r"^/|(^|/)\.\.?(/|$)|\\")
    p, s, e = col(provider), col(start).cast("string"), col(end).cast("string")
    hub = F.concat(web_base(base), F.lit("/blob/"), col(revision), F.lit("/"), col(file), F.lit("#L"), s, F.lit("-L"), e)
    lab = F.concat(web_base(base), F.lit("/-/blob/"), col(revision), F.lit("/"), col(file), F.lit("#L"), s, F.lit("-"), e)
    return F.when(ok & (p == "github"), hub).when(ok & (p == "gitlab"), lab)


def safe_url(url: Column | str) -> Column:
    """Whether an address is https with a host and without user, query, fragment, backslash or white space."""
    return col(url).rlike(r"^https://[^/@?#\\\s\p{Cntrl}]+(/[^?#\\\s\p{Cntrl}]*)?$")


def escape_html(c: Column | str) -> Column:
    out = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


# --- callables -----------------------------------------------------------------------------------

#: Prefixes of method names that write and that read (fixed values).
WRITES = ("set", "update", "save", "add", "remove", "close", "delete", "builder", "build", "<init>")
READS = ("get", "find", "is", "has", "contains", "load")


def access_class(name: Column | str) -> Column:
    """``W`` for names that begin like writes, else ``R`` for those that begin like reads, else null."""
    return F.when(col(name).rlike("^(" + "|".join(WRITES) + ")"), "W").when(col(name).rlike("^(" + "|".join(READS) + ")"), "R")


def step_class(kind: Column | str, target: Column | str) -> Column:
    """``D`` for decisions, else the access class of the method that is called."""
    method = F.substring_index(F.substring_index(col(target), "#", -1), "(", 1)
    return F.when(col(kind).isin("IF", "LOOP"), "D").otherwise(access_class(method))


DESCRIPTOR = r"\[*(?:[BCDFIJSZ]|L[^;()\[]+;)"
#: Type names of the primitive descriptors (fixed values).
PRIMITIVES = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean"}


def valid_descriptor(c: Column | str) -> Column:
    return col(c).rlike(rf"^\((?:{DESCRIPTOR})*\)(?:V|{DESCRIPTOR})$")


def descriptor_parameters(c: Column | str) -> Column:
    """Type names of the parameters of a method descriptor; empty for what is none."""
    inside = F.regexp_extract(col(c), r"^\(([^)]*)\)", 1)
    found = F.regexp_extract_all(inside, F.lit(f"({DESCRIPTOR})"), 1)
    depth = lambda t: F.length(F.regexp_extract(t, r"^(\[*)", 1))
    base = lambda t: F.regexp_replace(t, r"^\[+", "")
    names = F.create_map(*[F.lit(x) for kv in PRIMITIVES.items() for x in kv])
    plain = lambda t: F.when(F.startswith(base(t), F.lit("L")), F.replace(F.regexp_replace(base(t), "^L|;$", ""), F.lit("/"), F.lit("."))).otherwise(F.element_at(names, base(t)))
    typed = F.transform(found, lambda t: F.concat(plain(t), F.repeat(F.lit("[]"), depth(t))))
    return F.when(F.array_join(found, "") == inside, typed).otherwise(F.array().cast("array<string>"))


# --- bytes ---------------------------------------------------------------------------------------


def byte_prefix(c: Column | str, limit: int) -> Column:
    """The longest prefix of at most ``limit`` bytes of UTF-8 that ends with a whole character."""
    raw = F.encode(col(c), "UTF-8")
    within = lambda at: F.hex(raw.substr(F.lit(max(at, 1)), F.lit(1))).rlike("^[89AB]")
    cut = F.when(~within(limit + 1), limit).when(~within(limit), limit - 1).when(~within(limit - 1), limit - 2).otherwise(limit - 3)
    return F.when(F.octet_length(col(c)) <= limit, col(c)).otherwise(F.decode(raw.substr(F.lit(1), cut), "UTF-8"))


def line_at(text: Column | str, offset: Column | str) -> Column:
    """The line that a byte offset lies in, from 1; offsets outside count as the nearer end."""
    head = F.encode(col(text), "UTF-8").substr(F.lit(1), F.greatest(col(offset), F.lit(0)).cast("int"))
    pairs = F.regexp_replace(F.hex(head), "(..)", "$1 ")
    return (F.regexp_count(pairs, F.lit("0A ")) + 1).cast("int")


def find_bytes(text: Column | str, needle: Column | str) -> Column:
    """Byte offset of the first occurrence of a literal, or null."""
    pos = F.position(col(needle), col(text))
    return F.when(pos > 0, F.octet_length(F.left(col(text), pos - 1)).cast("long"))
