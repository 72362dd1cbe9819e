"""Markup as a token table, and the rules that clean it: no tree is built, nesting comes from running counts."""

from __future__ import annotations

from marginalia.functions.dialect import Spark

from .base import ATTR, attribute, decoded, is_lang, operator, squeeze, view, words

# What becomes of each element of a page.
KEPT = "h1 h2 h3 h4 h5 h6 p ul ol li blockquote strong em u s code sup sub br hr a img figure figcaption table caption thead tbody tfoot tr th td pre"
MAPPED = {"b": "strong", "i": "em", "strike": "s", "del": "s", "ins": "u", "tt": "code", "kbd": "code", "samp": "code", "var": "code", "dt": "p", "dd": "p"}
DROPPED = (
    "script style template iframe object embed applet frame frameset noscript noembed noframes xmp plaintext svg math form input button select "
    "textarea option datalist link meta base head title video audio canvas map area col colgroup source track param wbr"
)
CONTAINERS = "div section article aside nav header footer main address details summary fieldset legend dl center body html hgroup menu dialog"
BLOCKS = "h1 h2 h3 h4 h5 h6 p ul ol li blockquote hr figure figcaption table caption thead tbody tfoot tr th td pre dt dd"
VOID = "img br hr wbr input meta link base col area source track param embed"
HEADINGS = "h1 h2 h3 h4 h5 h6"
KEPT_ATTRS = "href src alt role lang scope colspan rowspan class data-needs-alt data-alt-source"
# End of fixed values.

TOKEN = r"""(?s)(<!--.*?-->|<[!?][^>]*>|</?[a-zA-Z][^"'>]*(?:"[^"]*"[^"'>]*|'[^']*'[^"'>]*){0,200}>|[^<]+|<)"""


def tokens_of(d: Spark, source: str) -> str:
    """(doc_id, pos, kind, tag, tok) of a source's (doc_id, html): open, close, void and text tokens in order; script and style content is never read."""
    raw = d.sub(d.sub("coalesce(html, '')", r"(?is)<script\b.*?</script\s*>"), r"(?is)<style\b.*?</style\s*>")
    parts = d.each(f"{source} pg", d.extract_all(raw, TOKEN, 1), "doc_id")
    tag = f"lower({d.extract('x', r'^</?([a-zA-Z][a-zA-Z0-9]*)', 1)})"
    return f"""
      select doc_id, cast(pos as bigint) pos, case when tag = '' then 'text' when x like '</%' then 'close' when tag in ({words(VOID)}) then 'void' else 'open' end kind, tag, x tok
      from (select doc_id, pos, x, {tag} tag from ({parts}) parts) tagged
      where not {d.like('x', r'^<[!?]')}"""


@view
def tokens(d: Spark) -> str:
    return tokens_of(d, "(select page_id doc_id, html from pages)")


@operator
def html_tokens(d: Spark) -> str:
    return "select doc_id, pos, kind, tag, tok from tokens"


@operator
def tag_census(d: Spark) -> str:
    return "select tag, count(*) n, count(distinct doc_id) pages from tokens where kind in ('open', 'void') group by tag"


@view
def fx_doc_lines(d: Spark) -> str:
    """The lines of the documents, numbered from 0 on."""
    return f"select doc_id, source, cast(pos as bigint) i, x text from ({d.each('documents', d.split('text', chr(10)), 'doc_id, source')}) dl"


@view
def tag_rules(d: Spark) -> str:
    rows = [(t, "kept", t) for t in KEPT.split()] + [(a, "mapped", b) for a, b in MAPPED.items()] + [(t, "dropped", "") for t in DROPPED.split()] + [(t, "container", "p") for t in CONTAINERS.split()]
    return "select * from (values " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in rows) + ") v(rule_tag, action, target)"


@operator
def tag_mapping(d: Spark) -> str:
    """What becomes of each element; those without a rule are unwrapped."""
    return """
      select tag, coalesce(action, 'unwrapped') action, coalesce(target, '') target, count(*) n
      from tokens left join tag_rules on tag = rule_tag where kind in ('open', 'void') group by all"""


def undropped_of(d: Spark, source: str) -> str:
    """Tokens outside every dropped element. A close without an open does not count below zero."""
    step = f"case when tag in ({words(DROPPED)}) and kind = 'open' then 1 when tag in ({words(DROPPED)}) and kind = 'close' then -1 else 0 end"
    return f"""
      select doc_id, pos, kind, tag, tok from (
        select *, level - least(0, min(level) over (partition by doc_id order by pos rows between unbounded preceding and current row)) inside from (
          select *, sum({step}) over (partition by doc_id order by pos rows between unbounded preceding and current row) level from {source}) a) b
      where inside = 0 and not (tag in ({words(DROPPED)}))"""


@view
def undropped(d: Spark) -> str:
    return undropped_of(d, "tokens")


@operator
def dropped_subtrees(d: Spark) -> str:
    return "select doc_id, count(*) tokens_left, count_if(kind = 'text') texts, max(pos) last_pos from undropped group by doc_id"


@operator
def nesting_depth(d: Spark) -> str:
    """Deepest list nesting and opens left unclosed, by running counts per family of tags."""
    return """
      select doc_id, cast(max(depth) as bigint) max_depth, cast(max(unclosed) as bigint) unclosed from (
        select doc_id, sum(case when tag in ('ul', 'ol') and kind = 'open' then 1 when tag in ('ul', 'ol') and kind = 'close' then -1 else 0 end)
                 over (partition by doc_id order by pos rows between unbounded preceding and current row) depth,
               sum(case when kind = 'open' then 1 when kind = 'close' then -1 else 0 end) over (partition by doc_id) unclosed
        from tokens) t group by doc_id"""


@operator
def implied_closes(d: Spark) -> str:
    """Opens that end an open p (any block), li (an li with no list opened between), cell, row, section of a table (with no table
    opened between) or term of a definition list."""
    blocks = " ".join(t for t in (BLOCKS + " " + CONTAINERS).split() if t not in "figcaption caption thead tbody tfoot tr th td li dt dd".split())
    before = "over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding)"
    families = {
        "p": ("p", blocks, f"(tag = 'p' and kind = 'close') or (tag in ({words(blocks)}) and tag <> 'p' and kind in ('open', 'void'))"),
        "li": ("li", "li", "(tag = 'li' and kind = 'close') or tag in ('ul', 'ol')"),
        "cell": ("td th", "td th tr thead tbody tfoot", "(tag in ('td', 'th') and kind = 'close') or tag in ('tr', 'thead', 'tbody', 'tfoot', 'table')"),
        "row": ("tr", "tr thead tbody tfoot", "(tag = 'tr' and kind = 'close') or tag in ('thead', 'tbody', 'tfoot', 'table')"),
        "part": ("thead tbody tfoot", "thead tbody tfoot", "(tag in ('thead', 'tbody', 'tfoot') and kind = 'close') or tag = 'table'"),
        "term": ("dt dd", "dt dd", "(tag in ('dt', 'dd') and kind = 'close') or tag = 'dl'"),
    }
    sums = ", ".join(f"max(case when tag in ({words(own)}) and kind = 'open' then pos end) {before} {n}_open, max(case when {ends} then pos end) {before} {n}_close" for n, (own, _, ends) in families.items())
    hits = " or ".join(f"(tag in ({words(closers)}) and {n}_open > coalesce({n}_close, -1))" for n, (_, closers, _) in families.items())
    return f"""
      select doc_id, tag, count(*) implied from (select *, {sums} from tokens) t
      where kind in ('open', 'void') and ({hits}) group by doc_id, tag"""


def attributes_of(d: Spark, source: str) -> str:
    """(doc_id, pos, tag, name, value) of every quoted attribute."""
    each = d.each(f"(select doc_id, pos tok_pos, tag, tok from {source} where kind in ('open', 'void')) tk", d.extract_all("tok", ATTR, 0), "doc_id, tok_pos, tag")
    value = decoded(d.sub(d.extract("x", r"(?s)=\s*(.*)$", 1), r"""^["']|["']$"""))
    return f"select doc_id, tok_pos pos, tag, lower({d.extract('x', r'^([a-zA-Z][a-zA-Z0-9:_-]*)', 1)}) name, {value} value from ({each}) atts"


@view
def attributes(d: Spark) -> str:
    return attributes_of(d, "tokens")


@operator
def attr_allowlist(d: Spark) -> str:
    return f"""
      select name attr, tag, name in ({words(KEPT_ATTRS)}) kept, name like 'on%' script, count(*) n from attributes group by all"""


def link_verdict(d: Spark, href: str) -> tuple[str, str]:
    """The address as it would stand in the cleaned page, and what becomes of it."""
    clean = d.sub(f"trim({d.sub(href, r'[\x{00}-\x{1F}\x{7F}]')})", r" +", "%20")
    verdict = f"""case when {href} is null or trim({href}) = '' then 'none'
      when {d.like(clean, r'(?i)^(javascript|vbscript|data):')} then 'script'
      when {d.like(clean, r'(?i)^(https?|mailto|tel):.')} then 'kept' else 'dropped' end"""
    return clean, verdict


@operator
def link_policy(d: Spark) -> str:
    clean, verdict = link_verdict(d, "value")
    return f"""
      select doc_id, row_number() over (partition by doc_id order by pos) ordinal, {clean} href, {verdict} verdict
      from attributes where tag = 'a' and name = 'href'"""


@operator
def link_policy_mix(d: Spark) -> str:
    """The same rule over links of every scheme."""
    clean, verdict = link_verdict(d, "href")
    return f"select doc_id, ordinal, {clean} href, {verdict} verdict from fx_links"


@operator
def image_policy(d: Spark) -> str:
    """Whether a picture's source is embedded, on the net, on a share, a script, a file or nothing."""
    return f"""
      select doc_id, ordinal, case when trim(coalesce(src, '')) = '' then 'empty'
        when {d.like('src', r'(?i)^data:image/(png|jpeg|jpg|gif|webp|bmp);base64,')} then 'embedded'
        when {d.like('src', r'(?i)^(javascript|vbscript|data):')} then 'script'
        when {d.like('src', r'(?i)^https?:')} then 'remote'
        when {d.like('src', r'^[\\/]{2}')} or {d.like('src', r'(?i)^file://[^/]')} then 'share' else 'local' end verdict
      from fx_pictures"""


@view
def block_runs(d: Spark) -> str:
    """Tokens with the number of block boundaries so far: between two boundaries lies one run of inline content."""
    blocks = words(BLOCKS + " " + CONTAINERS)
    return f"""
      select *, sum(case when tag in ({blocks}) then 1 else 0 end) over (partition by doc_id order by pos rows between unbounded preceding and current row) run
      from undropped"""


@operator
def bare_text_runs(d: Spark) -> str:
    """Runs of inline content that stand outside a p, heading or list item, as paragraphs of their own."""
    body = squeeze(d, d.join(decoded("tok"), "", "pos", "kind = 'text'"))
    return f"""
      select doc_id, cast(run as bigint) run_id, txt text from (
        select doc_id, run, {body} txt, min(case when tag <> '' and run_first then tag end) opener, min(case when run_first then kind end) opener_kind
        from (select *, pos = min(pos) over (partition by doc_id, run) run_first from block_runs) r group by doc_id, run) t
      where txt <> '' and not (coalesce(opener_kind, '') = 'open' and coalesce(opener, '') in ({words(HEADINGS + ' p li')}))"""


@operator
def empty_blocks(d: Spark) -> str:
    """Blocks that open and close with nothing to notice between: no text but white space, no picture, rule or table; and lists, rows and tables without an element in them."""
    solid = r"[^\s\x{A0}\x{200B}\x{200C}\x{200D}\x{FEFF}]"
    return f"""
      select doc_id, tag, count(*) removed from (
        select doc_id, run, min(case when first_row then tag end) tag, min(case when first_row then kind end) kind,
               count_if(kind = 'text' and {d.like(decoded('tok'), solid)}) solid, count_if(tag in ('img', 'hr', 'table')) things, count_if(kind in ('open', 'void')) elements, max(run_next_kind) nk, max(run_next_tag) nt
        from (select *, pos = min(pos) over (partition by doc_id, run) first_row,
                lead(kind) over (partition by doc_id order by pos) run_next_kind0, case when lead(run) over (partition by doc_id order by pos) <> run then lead(kind) over (partition by doc_id order by pos) end run_next_kind,
                case when lead(run) over (partition by doc_id order by pos) <> run then lead(tag) over (partition by doc_id order by pos) end run_next_tag from block_runs) r
        group by doc_id, run) t
      where kind = 'open' and nk = 'close' and nt = tag and (tag in ({words(HEADINGS + ' p li blockquote figcaption caption')}) and solid = 0 and things = 0 or tag in ({words('ul ol table thead tbody tfoot tr')}) and elements = 1)
      group by doc_id, tag"""


@operator
def plain_text(d: Spark) -> str:
    """A page's words: a newline after each block and br, three or more newlines made two."""
    piece = f"case when kind = 'text' then {decoded('tok')} when tag = 'br' or (kind = 'close' and tag in ({words(BLOCKS)})) then chr(10) else '' end"
    return f"""
      select doc_id, text, cast({d.count('text', r'[^ \t\n\r\f\v]+')} as bigint) words from (
        select doc_id, trim({d.sub(d.join(piece, '', 'pos'), r'\n{3,}', '\n\n')}) text from undropped group by doc_id) t"""


@operator
def rtl_audit(d: Spark) -> str:
    n = d.count("coalesce(text, '')", r"[\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]")
    return f"select doc_id, {n} rtl_chars from fx_rtl_texts"


@operator
def header_scope(d: Spark) -> str:
    """Scope of header cells, and spans that are kept: 2 to 1000."""
    return f"""
      select doc_id, tbl, r, c, case when scope is not null then scope when all_th then 'col' when c = 0 then 'row' else 'col' end scope,
             case when {d.like("coalesce(colspan, '')", r'^[0-9]{1,4}$')} and cast(case when {d.like("coalesce(colspan, '')", r'^[0-9]{1,4}$')} then colspan end as int) between 2 and 1000 then colspan end span
      from (select *, r = 0 and bool_and(tag = 'th') over (partition by doc_id, tbl, r) all_th from fx_cells) t where tag = 'th'"""


def _head(d: Spark) -> str:
    return d.extract("html", r"(?is)^(.*?)(?:<body\b|$)", 1)


def _metas(d: Spark, head: str) -> str:
    """The head's named metas, in order, as an array of (name, content)."""
    every = d.extract_all(head, r"""(?i)(<meta\b(?:[^>"']|"[^"]*"|'[^']*')*>)""", 1)
    pair = d.struct(name=f"lower(trim({attribute(d, 'm', 'name')}))", content=attribute(d, "m", "content"))
    return f"list_filter(list_transform({every}, lambda m: {pair}), lambda p: p.name <> '')" if d.name == "duck" else f"filter(transform({every}, m -> {pair}), p -> p.name <> '')"


@operator
def page_metadata(d: Spark) -> str:
    """Title, language code, author and subject of a page's head. Attributes stand in any order, quoted or not; the last meta of a name counts."""
    head = _head(d)
    lang = d.extract("html", r'''(?is)<html[^>]*\blang\s*=\s*["']?([^"'\s>]*)''', 1)
    title = squeeze(d, decoded(d.extract(head, r"(?is)<title[^>]*>(.*?)</title", 1)))
    last = lambda n: f"trim(coalesce(list_filter(metas, lambda p: p.name = '{n}')[-1].content, ''))" if d.name == "duck" else f"trim(coalesce(get(reverse(filter(metas, p -> p.name = '{n}')), 0).content, ''))"
    return f"""
      select page_id, title, lang, {last('author')} author, {last('description')} subject, n metas from (
        select page_id, {title} title, case when {is_lang(d, lang)} then {lang} else '' end lang, {_metas(d, head)} metas, {d.count(head, r'(?is)<meta\b')} n from pages) h"""


@operator
def page_meta_pairs(d: Spark) -> str:
    """Every named meta of a page's head; the last of a name counts."""
    name, content = ("x.name", "x.content")
    return f"select page_id, name, content from (select page_id, {name} name, {content} content, row_number() over (partition by page_id, {name} order by pos desc) n from ({d.each('pages', _metas(d, _head(d)), 'page_id')}) e) r where n = 1"


@operator
def page_body(d: Spark) -> str:
    inner = d.extract("html", r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)", 1)
    bare = d.sub(d.sub("html", r"(?is)<!doctype[^>]*>|<head\b.*?</head\s*>"), r"(?is)</?(html|head|body)\b[^>]*>")
    return f"select page_id, case when {d.like('html', r'(?i)<body')} then {inner} else {bare} end body from pages"


@operator
def text_paragraphs(d: Spark) -> str:
    """Blank lines part paragraphs, single newlines join; edges trimmed, empty ones dropped."""
    return f"""
      select doc_id, row_number() over (partition by doc_id order by pos) ordinal, paragraph from (
        select doc_id, pos, {squeeze(d, d.sub('x', r'[ \t]*\n[ \t]*', ' '))} paragraph from ({d.each('fx_plain_texts', d.split("coalesce(text, '')", r'\n[ \t\r\f\v]*\n'), 'doc_id')}) s) t
      where paragraph <> ''"""


@operator
def clean_warnings(d: Spark) -> str:
    """What cleaning would report of a page, in fixed order."""
    _, verdict = link_verdict(d, "value")
    rtl = r"[\x{0590}-\x{05FF}\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]"
    return f"""
      select doc_id, ord, warning, sum(n) n from (
        select doc_id, 1 ord, 'no description' warning, count(*) n from tokens where tag = 'img' and not {d.like('tok', r'(?i)\balt\s*=')} group by doc_id
        union all select doc_id, case when value = 'pdf' then 3 else 2 end, case when value = 'pdf' then 'recovered description' else 'description by a model' end, count(*) from attributes
          where tag = 'img' and name = 'data-alt-source' and (value = 'pdf' or value like 'ai%') group by doc_id, value = 'pdf', case when value = 'pdf' then 3 else 2 end, case when value = 'pdf' then 'recovered description' else 'description by a model' end
        union all select doc_id, 7, 'pictures dropped', count(*) from attributes where tag = 'img' and name = 'src' and not {d.like('value', r'(?i)^data:image/(png|jpeg|jpg|gif|webp|bmp);base64,')} group by doc_id
        union all select doc_id, 4, 'right to left text', count(*) from undropped where kind = 'text' and {d.like('tok', rtl)} group by doc_id
        union all select page_id, 5, 'script removed', {d.count('html', r'(?i)<script')} from pages where {d.like('html', r'(?i)<script')}
        union all select doc_id, 5, 'script removed', count(*) from attributes where name like 'on%' group by doc_id
        union all select doc_id, 6, 'links dropped', count(*) from attributes where tag = 'a' and name = 'href' and {verdict} in ('dropped', 'script') group by doc_id) w
      group by doc_id, ord, warning""".replace("sum(n) n", "cast(sum(n) as bigint) n")
