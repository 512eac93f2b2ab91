"""Text predicates, classifiers and small parsers as native Column builders.

Every rule list below is a parameter; the defaults are the fixed values the
crawl jobs use (marked as such).  Matching is plain substring containment on
the column as given (case-sensitive unless a function says it lowercases),
which Catalyst can push into Parquet scans as ``StringContains``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from webrake.functions.common import ColumnOrName, as_col, lines, tokens

# ---------------------------------------------------------------------------
# Fixed values (rules of the crawl jobs).
# Title keywords marking a graduate/doctoral/postdoctoral role; "graduate"
# counts only without "under".
GRADUATE_ANY = ["phd", "doctor", "ph.d", "post"]
GRADUATE_WITH = "graduate"
GRADUATE_WITHOUT = "under"
# URL deny-lists, case-sensitive substrings.
CV_DENY = [".pdf", ".doc", "www.ch.ntu.edu.tw/facultys/cv"]
STUDENT_DENY = [".pdf", "researchgate", "ir.pku.edu.cn", "4amap.arizona.edu"]
STUDENT_DENY_PAIRS = [("linkedin", "search")]
PERSONAL_SITE_WORDS = [
    "linkedin", "researchgate", "scholar.google", "wikipedia",
    "youtube", "reddit", "twitter", "x.com", "facebook", "instagram",
    "github", "gitlab", "bitbucket", "slides", "frontiersin",
]
GROUP_DENY = [".pdf"] + PERSONAL_SITE_WORDS
# Search-hit score rules, first match wins, title or snippet, lowercased.
GROUP_HIT_RULES = [("member", 10), ("graduate", 7), ("people", 5), ("profile", -5)]
# Interstitial page title phrase.
INTERSTITIAL_PHRASES = ["just a moment"]
# Search keyword templates ({name} style placeholders).
SEARCH_TEMPLATES = {
    "cv": "professor {name} {institute} (CV or resume or homepage or profile)",
    "student": "{name} from {institute}",
    "group": "(research group of {advisor}) AND (members or people) AND (graduate or phd or postdoctoral) {institute}",
    "author": 'author:"{author}"',
}
# Script range used for the CJK test.
CJK_RANGE = ("一", "龥")
# ---------------------------------------------------------------------------


def contains_any(c: ColumnOrName, words: Sequence[str]) -> Column:
    col = as_col(c)
    if not words:
        return F.lit(False)
    out = None
    for w in words:
        term = col.contains(w)
        out = term if out is None else (out | term)
    return out


def deny_url(url: ColumnOrName, any_of: Sequence[str] = (),
             pairs: Sequence[tuple[str, ...]] = ()) -> Column:
    """True when the URL hits a deny rule: any single substring, or all
    substrings of one conjunctive tuple."""
    col = as_col(url)
    cond = contains_any(col, any_of)
    for tup in pairs:
        term = None
        for w in tup:
            t = col.contains(w)
            term = t if term is None else (term & t)
        cond = cond | term
    return F.coalesce(cond, F.lit(False))


def keep_url(url: ColumnOrName, any_of: Sequence[str] = (),
             pairs: Sequence[tuple[str, ...]] = ()) -> Column:
    """Filter form of ``~deny_url``: null URLs are kept, and the predicate
    is plain ``NOT (contains OR ...)`` so it is listed in the scan's
    ``PushedFilters``."""
    col = as_col(url)
    cond = contains_any(col, any_of)
    for tup in pairs:
        term = None
        for w in tup:
            t = col.contains(w)
            term = t if term is None else (term & t)
        cond = cond | term
    return col.isNull() | ~cond


def valid_cv_url(url: ColumnOrName) -> Column:
    return ~deny_url(url, CV_DENY)


def valid_student_url(url: ColumnOrName) -> Column:
    return ~deny_url(url, STUDENT_DENY, STUDENT_DENY_PAIRS)


def valid_group_url(url: ColumnOrName) -> Column:
    return ~deny_url(url, GROUP_DENY)


def keyword_class(text: ColumnOrName, any_of: Sequence[str] = GRADUATE_ANY,
                  with_word: str | None = GRADUATE_WITH,
                  without_word: str | None = GRADUATE_WITHOUT) -> Column:
    """Lowercased text contains any keyword, or contains ``with_word`` and
    not ``without_word``.  Null text counts as empty."""
    t = F.lower(F.coalesce(as_col(text), F.lit("")))
    cond = contains_any(t, [w.lower() for w in any_of])
    if with_word:
        extra = t.contains(with_word.lower())
        if without_word:
            extra = extra & ~t.contains(without_word.lower())
        cond = cond | extra
    return cond


def is_graduate(title: ColumnOrName) -> Column:
    return keyword_class(title)


def score_hit(title: ColumnOrName, snippet: ColumnOrName,
              rules: Sequence[tuple[str, int]] = GROUP_HIT_RULES,
              default: int = 0) -> Column:
    """First rule whose keyword is in the lowercased title or snippet gives
    the score; rule order beats field order.  Nulls count as empty."""
    t = F.lower(F.coalesce(as_col(title), F.lit("")))
    s = F.lower(F.coalesce(as_col(snippet), F.lit("")))
    expr = None
    for word, score in rules:
        cond = t.contains(word) | s.contains(word)
        expr = F.when(cond, F.lit(score)) if expr is None else expr.when(cond, F.lit(score))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default))


def script_range(text: ColumnOrName, lo: str = CJK_RANGE[0],
                 hi: str = CJK_RANGE[1]) -> Column:
    """Any character in [lo, hi]."""
    return F.coalesce(as_col(text).rlike(f"[{lo}-{hi}]"), F.lit(False))


def any_token_in(text: ColumnOrName, lexicon: Sequence[str]) -> Column:
    """Some lowercased whitespace token is in the (lowercase) lexicon.
    For lexicons held as tables use ``operators.lexicon.any_token_in_table``."""
    lex = F.array(*[F.lit(w.lower()) for w in lexicon]) if lexicon else F.array().cast("array<string>")
    return F.coalesce(F.arrays_overlap(tokens(F.lower(as_col(text))), lex), F.lit(False))


def last_token(text: ColumnOrName) -> Column:
    return F.try_element_at(tokens(text), F.lit(-1))


def last_token_in(text: ColumnOrName, lexicon: Sequence[str],
                  or_script: bool = True) -> Column:
    """The last whitespace token (lowercased) is in the lexicon, or the
    text has a character of the CJK range."""
    hit = F.coalesce(F.lower(last_token(text)).isin([w.lower() for w in lexicon]), F.lit(False))
    if or_script:
        hit = script_range(text) | hit
    return hit


def screen(text: ColumnOrName, allow: Sequence[str], deny: Sequence[str]) -> Column:
    """struct<accept BOOLEAN, rule STRING>: the first allow token (in list
    order) contained in the text accepts with that rule; else the first deny
    token rejects; else accept with a null rule.  A ``CASE`` chain (code
    generated); pass a column as ``text`` so it is computed once."""
    t = F.coalesce(as_col(text), F.lit(""))

    def res(accept, rule):
        return F.struct(F.lit(accept).alias("accept"), F.lit(rule).cast("string").alias("rule"))

    out = None
    for accept, words in ((True, allow), (False, deny)):
        for w in words:
            cond = t.contains(w)
            out = F.when(cond, res(accept, w)) if out is None else out.when(cond, res(accept, w))
    return res(True, None) if out is None else out.otherwise(res(True, None))


def regex_first(text: ColumnOrName, pattern: str, group: int = 1) -> Column:
    """First match group, null when there is none."""
    t = as_col(text)
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, group))


def email_domain(brief: ColumnOrName) -> Column:
    return regex_first(brief, r"Verified email at (\S+)", 1)


def cited_stats(text: ColumnOrName) -> Column:
    """struct<all BIGINT, recent BIGINT> from the second line, which must be
    exactly three whitespace tokens with two integers last; null otherwise
    (route such rows to quarantine with ``isNull``)."""
    line = F.get(lines(text), 1)
    toks = tokens(line)
    ok = F.size(toks) == 3
    c_all = F.when(ok, F.get(toks, 1).try_cast("bigint"))
    c_recent = F.when(ok, F.get(toks, 2).try_cast("bigint"))
    return F.when(c_all.isNotNull() & c_recent.isNotNull(),
                  F.struct(c_all.alias("all"), c_recent.alias("recent")))


def safe_ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b when b > 0 else 0.0."""
    bb = as_col(b)
    return F.when(bb > 0, as_col(a).cast("double") / bb).otherwise(F.lit(0.0))


def last_line(text: ColumnOrName) -> Column:
    """Text after the last ``\\n`` (the whole text when there is none)."""
    return F.substring_index(as_col(text), "\n", -1)


def join_list(arr: ColumnOrName, sep: str = "\n") -> Column:
    return F.array_join(as_col(arr), sep)


def search_query(kind: str, **cols: ColumnOrName) -> Column:
    """Search keywords for a target row from a fixed template."""
    tmpl = SEARCH_TEMPLATES[kind]
    pieces = []
    i = 0
    while i < len(tmpl):
        j = tmpl.find("{", i)
        if j < 0:
            pieces.append(F.lit(tmpl[i:]))
            break
        if j > i:
            pieces.append(F.lit(tmpl[i:j]))
        k = tmpl.index("}", j)
        pieces.append(F.coalesce(as_col(cols[tmpl[j + 1:k]]), F.lit("")))
        i = k + 1
    return F.concat(*pieces)


def author_query(author: ColumnOrName, keyword: ColumnOrName | None = None) -> Column:
    q = search_query("author", author=author)
    if keyword is None:
        return q
    kw = as_col(keyword)
    return F.when((kw.isNotNull()) & (kw != ""), F.concat(q, F.lit(" "), kw)).otherwise(q)


def report_search_link(name: ColumnOrName, email: ColumnOrName,
                       prefix: str = "https://www.google.com/search?q=") -> Column:
    """Search link for a report row: name, plus `` at <email>`` when known."""
    from webrake.functions.urls import percent_encode
    e = as_col(email)
    kw = F.when(e.isNotNull() & (e != ""), F.concat(as_col(name), F.lit(" at "), e)).otherwise(as_col(name))
    return F.concat(F.lit(prefix), percent_encode(kw))


def is_interstitial(title: ColumnOrName, phrases: Sequence[str] = INTERSTITIAL_PHRASES) -> Column:
    return F.coalesce(contains_any(F.lower(as_col(title)), [p.lower() for p in phrases]), F.lit(False))
