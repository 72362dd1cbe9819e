"""Where operators and views register, and column expressions that many of them use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from marginalia.functions.dialect import Spark

Sql = Callable[[Spark], str]
OPERATORS: dict[str, Sql] = {}
VIEWS: dict[str, Sql] = {}
#: Views that Spark makes in rounds of joins, by a function of the frames they read; SQL for DuckDB stands beside it as ``check``.
BUILT: dict[str, Callable[..., DataFrame]] = {}
#: Views that Spark computes once, as a table, where a query reads them more than once; some are in fixtures.sql.
STORED = {"fx_li", "fx_lp", "fx_recognised", "page_clean", "clean_tokens", "block_tokens"}
#: Stored views that lie by this column's hash, and hold what a query reads of them only.
BY = {"fx_li": "doc_id", "fx_lp": "doc_id"}
#: Those that are a table even where they are read once, as Spark would work them out again for each filter that it infers.
ALWAYS = {"page_clean"}


def operator(f: Sql) -> Sql:
    """Registers a query of that name."""
    OPERATORS[f.__name__] = f
    return f


def view(f: Sql) -> Sql:
    """Registers an input that operators name."""
    VIEWS[f.__name__] = f
    return f


def stored(f: Sql) -> Sql:
    """A view worth a table of its own where a query reads it more than once."""
    STORED.add(f.__name__)
    return view(f)


def built(*reads: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers an input that is a function of the frames of the views it reads."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        f.reads = reads
        BUILT[f.__name__] = f
        VIEWS[f.__name__] = lambda d: f.check(d) if d.name == "duck" else " union all ".join(f"select * from {r}" for r in reads)
        return f

    return register


def words(values: str) -> str:
    """A list of names as SQL literals."""
    return ", ".join(f"'{v}'" for v in values.split())


def banded(d: Spark, source: str, low: str, high: str, size: int = 32) -> str:
    """Rows of a source once for each band of so many points that they reach into, for a join of boxes on a page: only what shares a
    band is compared. The check in DuckDB compares all of a page."""
    at = lambda y: f"cast(floor(({y}) / {size}) as int)"
    return f"(select * from {source})" if d.name == "duck" else f"(select *, {at(low)} band0, explode(sequence({at(low)}, greatest({at(low)}, {at(high)}))) band from {source})"


def meet(d: Spark, a: str, b: str) -> str:
    """Whether two banded rows stand in the first band that they share."""
    return "true" if d.name == "duck" else f"{a}.band = {b}.band and {a}.band = greatest({a}.band0, {b}.band0)"


def squeeze(d: Spark, s: str) -> str:
    return f"trim({d.sub(s, r'[ \t\n\r\f\v]+', ' ')})"


# The form of a language code; white space, and characters that no reader can use.
LANG = r"^[A-Za-z]{2,3}(-[A-Za-z0-9]{1,8})*$"
SPACE = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
UNREADABLE = r"[\x{FFFD}\x{E000}-\x{F8FF}\x{00}-\x{1F}\x{7F}-\x{9F}]"
# End of fixed values.


def is_lang(d: Spark, s: str) -> str:
    return d.like(s, LANG)


def decoded(s: str) -> str:
    """The character references that pages hold, as characters; the ampersand last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\u00a0"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        s = f"replace({s}, '{name}', '{char}')"
    return s


ATTR = r"""[a-zA-Z][a-zA-Z0-9:_-]*\s*=\s*"[^"]*"|[a-zA-Z][a-zA-Z0-9:_-]*\s*=\s*'[^']*'"""


def _unquoted(d: Spark, tok: str) -> str:
    """A tag with its quoted values left out, so that no value looks like an attribute."""
    return d.sub(tok, '"[^"]*"' + "|'[^']*'", '""')


def has_attribute(d: Spark, tok: str, name: str) -> str:
    """Whether a tag has the attribute, with a value or without."""
    return d.like(_unquoted(d, tok), rf'(?i)["\s/]{name}(\s|=|/|>|$)')


def attribute(d: Spark, tok: str, name: str) -> str:
    """The value of a tag's attribute, quoted or not; an empty text where it has none."""
    every, mine = d.extract_all(tok, ATTR, 0), d.like("y", rf"(?i)^{name}\s*=")
    first = f"list_filter({every}, lambda y: {mine})[1]" if d.name == "duck" else f"get(filter({every}, y -> {mine}), 0)"
    quoted = decoded(d.sub(d.extract(first, r"(?s)=\s*(.*)$", 1), r"""^["']|["']$"""))
    return f"coalesce({quoted}, {d.extract(_unquoted(d, tok), rf"""(?i)["\s/]{name}\s*=\s*([^\s"'>]+)""", 1)})"


def bad_share(d: Spark, s: str) -> str:
    """Share of characters other than white space that no reader can use; 0 for none."""
    solid = d.sub(s, SPACE, "")
    bad = d.count(solid, UNREADABLE)
    return f"case when length({solid}) = 0 then 0.0D else cast({bad} as double) / length({solid}) end".replace("0.0D", "cast(0 as double)")


def reads(d: Spark, s: str) -> str:
    """Whether somebody could read it: three letters or more, and few symbols."""
    return f"({d.count(s, r'\p{L}')} >= 3 and {bad_share(d, s)} < 0.15)"
