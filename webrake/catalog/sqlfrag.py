"""DuckDB SQL fragments used by the oracle statements.

These restate the semantics of the Column builders in DuckDB's dialect
(``regexp_replace`` needs the ``'g'`` flag, group references are ``\\1``,
lambdas are ``lambda x: ...``).  They are independent of the Spark code.
"""

from __future__ import annotations


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def url_part(url: str, idx: int) -> str:
    """Scheme (1), network location (2), path (3) or query (4) by splitting
    at ``#``, ``?``, ``://`` and ``/``: every given url is absolute."""
    whole = f"split_part({url}, '#', 1)"
    base = f"split_part({whole}, '?', 1)"
    if idx == 1:
        return f"split_part({base}, '://', 1)"
    if idx == 2:
        return f"split_part({base}, '/', 3)"
    if idx == 3:
        return f"substr({base}, length(split_part({base}, '/', 1)) + length(split_part({base}, '/', 3)) + 3)"
    return f"substr({whole}, length({base}) + 2)"


def url_path(url: str) -> str:
    """Path without the ``;params`` of its last segment (web schemes)."""
    p = url_part(url, 3)
    last = f"string_split({p}, '/')[-1]"
    return f"(left({p}, length({p}) - length({last})) || split_part({last}, ';', 1))"


def has_ext(name: str) -> str:
    return f"regexp_matches(regexp_extract({name}, '[^/]*$', 0), '^\\.*[^.].*\\.')"


def url_key(url: str, include_query: bool = False, no_ext: bool = False) -> str:
    name = f"replace({url_path(url)}, '/', '_')"
    if include_query:
        name = f"({name} || {url_part(url, 4)})"
    if not no_ext:
        name = f"(CASE WHEN {has_ext(name)} THEN {name} ELSE {name} || '.html' END)"
    return f"({url_part(url, 2)} || {name})"


def url_param(url: str, name: str) -> str:
    arr = f"regexp_extract_all({url_part(url, 4)}, {q('(?:^|&)' + name + '=([^&]*)')}, 1)"
    return f"(CASE WHEN len({arr}) > 0 THEN {arr}[-1] END)"


DROP_BLOCKS = ["script", "style", "noscript", "svg", "img", "iframe", "code"]


def drop_blocks(html: str, tags=DROP_BLOCKS) -> str:
    out = html
    for t in tags:
        if t == "img":
            pat = rf"(?i)<{t}\b[^>]*>(?:</{t}\s*>)?"
        else:
            pat = rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>"
        out = f"regexp_replace({out}, {q(pat)}, '', 'g')"
    return out


def drop_attrs(html: str) -> str:
    return f"regexp_replace({html}, '<([A-Za-z][A-Za-z0-9]*)\\s[^>]*>', '<\\1>', 'g')"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^[ \\t\\n\\r\\f\\x0B]+|[ \\t\\n\\r\\f\\x0B]+$', '', 'g')"


def strip_tags(x: str) -> str:
    t = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', ' ', 'g')"
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                    ("&nbsp;", " "), ("&amp;", "&")):
        t = f"replace({t}, {q(ent)}, {q(ch)})"
    t = f"regexp_replace({t}, '[ \\t\\n\\r\\f]+', ' ', 'g')"
    return strip_ws(t)


def element_text(html: str, tag: str) -> str:
    return f"regexp_extract({html}, {q(rf'(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>')}, 1)"


def html_title(html: str) -> str:
    return element_text(html, "title")


def first_paragraph(html: str) -> str:
    return strip_tags(element_text(drop_blocks(html, ["script"]), "p"))


def html_links(html: str) -> str:
    # the given pages write every link as <a href="...">
    return f"""list_transform(string_split({drop_blocks(html, ['script'])}, '<a href="')[2:], lambda s: string_split(s, '"')[1])"""


def tokens(x: str) -> str:
    return (f"list_filter(regexp_split_to_array({strip_ws(x)}, '[ \\t\\n\\r\\f\\x0B]+'), "
            f"lambda t: t <> '')")


def lines(x: str) -> str:
    parts = f"regexp_split_to_array({x}, '\\r\\n|\\n|\\r')"
    return (f"(CASE WHEN {parts}[-1] = '' THEN {parts}[1:len({parts}) - 1] ELSE {parts} END)")


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def deny_url(url: str, any_of=(), pairs=()) -> str:
    terms = [f"contains({url}, {q(w)})" for w in any_of]
    for tup in pairs:
        terms.append("(" + " AND ".join(f"contains({url}, {q(w)})" for w in tup) + ")")
    return "coalesce(" + " OR ".join(terms) + ", false)" if terms else "false"


def score_hit(title: str, snippet: str, rules, default: int = 0) -> str:
    t, s = f"lower(coalesce({title}, ''))", f"lower(coalesce({snippet}, ''))"
    whens = " ".join(f"WHEN contains({t}, {q(w)}) OR contains({s}, {q(w)}) THEN {sc}"
                     for w, sc in rules)
    return f"(CASE {whens} ELSE {default} END)"


HITS = (
    f"SELECT {url_part('url', 2)} AS entity_key, page_id AS pos, url, "
    f"{html_title('html')} AS title, {first_paragraph('html')} AS snippet FROM pages"
)
