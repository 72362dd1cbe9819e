"""Outlines, words, pictures and text search."""

from __future__ import annotations

from marginalia.functions.dialect import Spark

from .base import attribute, decoded, has_attribute, operator, squeeze, view
from .html import HEADINGS, words


# The labels of an outline's lines, what is said of a picture, and where its links are cut.
LABELS = {"p": "Paragraph", "li": "List item", "blockquote": "Quotation", "figcaption": "Caption", "pre": "Preformatted text", "dt": "Term", "dd": "Definition"}
BY_MODEL = " (this description was written by AI and has not been checked by a sighted person)"
RECOVERED = " (this description was recovered from a file and has not been checked)"
HREF_CHARS = 120
# End of fixed values.

#: Blocks whose first paragraph bears their label, and containers that end a line where they open.
_BEARS, _PARTS = "li blockquote figcaption dd", "div section article ul ol figure hr"
_LABELLED = f"{HEADINGS} {' '.join(LABELS)}"


def _label(tag: str) -> str:
    return f"case when {tag} in ({words(HEADINGS)}) then 'Heading level ' || substr({tag}, 2, 1) " + " ".join(f"when {tag} = '{t}' then '{v}'" for t, v in LABELS.items()) + " end"


def _link_mark(href: str) -> str:
    """What follows a link's text; nothing where it has no address or holds data."""
    return f"case when trim({href}) <> '' and not (lower(trim({href})) like 'data:%') then ' (link to ' || substr(trim({href}), 1, {HREF_CHARS}) || ')' else '' end"


def _picture(d: Spark, number: str) -> tuple[str, str]:
    """Label and text of a picture's line."""
    plain = f"trim({d.sub('alt', r'[ \t\n\r\f\v]+', ' ')})"
    label = f"case when {plain} <> '' then 'Picture ' || cast({number} as string) || ', described as' else '' end"
    text = f"""case when {plain} <> '' then {plain} || case when lower(alt_source) like 'ai:%' then '{BY_MODEL}' when alt_source <> '' then '{RECOVERED}' else '' end
      when has_alt and (lower(role) in ('presentation', 'none') or lower(hidden) = 'true') then 'Picture ' || cast({number} as string) || ', marked decorative, no description.'
      else 'Picture ' || cast({number} as string) || ', no description.' end"""
    return label, text


@view
def outline_tokens(d: Spark) -> str:
    """Tokens with what an outline asks of their attributes."""
    at = lambda name: attribute(d, "tok", name)
    return f"""select doc_id, pos, kind, tag, case when kind = 'text' then {decoded('tok')} end said, case when tag = 'a' and kind = 'open' then {at('href')} end href, case when tag = 'img' then {at('alt')} end alt,
        case when tag = 'img' then {has_attribute(d, 'tok', 'alt')} end has_alt, case when tag = 'img' then {at('role')} end role, case when tag = 'img' then {at('aria-hidden')} end hidden, case when tag = 'img' then {at('data-alt-source')} end alt_source
      from undropped"""


def _outline_runs() -> str:
    """One row a run between two boundaries: the boundary that begins it, and the text up to the next one.

    A p straight after the open of an item, quotation, caption or definition is no boundary. A row runs from a tr, or from a cell
    outside any row, to the next tr close; the text before a cell's close is that cell's.
    """
    w = "over (partition by doc_id order by pos rows between unbounded preceding and current row)"
    before = "over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding)"
    is_open = lambda tags: f"(kind in ('open', 'void') and tag in ({words(tags)}))"
    is_close = lambda tags: f"(kind = 'close' and tag in ({words(tags)}))"
    last = lambda when, over: f"max(case when {when} then pos end) {over}"
    return f"""
      select *, sum(case when boundary then 1 else 0 end) {w} run, max(case when starts then pos end) {w} row_at from (
        select *, hard or ({is_open('p')} and not (coalesce(bearer, false) and coalesce(solid_at < hard_at, true))) boundary from (
          select *, {last('hard', before)} hard_at, max_by({is_open(_BEARS)}, case when hard then pos end) {before} bearer, {last("trim(coalesce(said, '')) <> '' or mark <> ''", before)} solid_at from (
            select *, ({is_open(_LABELLED.replace(' p ', ' ') + ' img table tr td th ' + _PARTS)} or {is_close(_LABELLED + ' table')} or (active and {is_close('tr td th')})) hard,
                   {is_open('tr')} or (not active and {is_open('td th')}) starts, case when {is_close('a')} and a_open > coalesce(a_close, -1) then {_link_mark('link')} else '' end mark from (
              select *, coalesce({last(is_open('tr td th'), before)} > coalesce({last(is_close('tr'), before)}, -1), false) active,
                     {last(is_open('a'), before)} a_open, {last(is_close('a'), before)} a_close, max_by(href, case when {is_open('a')} then pos end) {before} link,
                     coalesce({last(is_open('th'), w)} > coalesce({last(is_open('tr'), w)}, -1), false) header, {last(is_open('table'), w)} tbl, sum(case when {is_open('img')} then 1 else 0 end) {w} pictures
              from outline_tokens) t1) t2) t3) t4"""


@view
def outline_states(d: Spark) -> str:
    """The check's way: a token a step, with the text, label, link and row so far."""
    flat = lambda s: squeeze(d, s)
    label, text = _picture(d, "pics + 1")
    bears = ", ".join(f"'{LABELS[t]}'" for t in _BEARS.split())
    step = "select s.doc_id, s.n, s.buf, s.label, s.link, s.cells, s.header, s.n_rows, s.n_cols, s.pics, x.kind, x.tag, x.said, x.href, x.alt, x.has_alt, x.role, x.hidden, x.alt_source from outline_states s join outline_numbered x on x.doc_id = s.doc_id and x.n = s.n + 1"
    step = f"""select *, kind in ('open', 'void') opens, {flat('buf')} body, kind = 'close' and tag in ('td', 'th') and cells is not null cell, kind = 'close' and tag = 'tr' and cells is not null ended from ({step}) q1"""
    step = f"""select *, case when opens and tag = 'p' then not (coalesce(label, '') in ({bears}) and body = '') when opens then tag in ({words(_LABELLED + ' img table tr td th ' + _PARTS)}) else ended or (kind = 'close' and tag in ({words(_LABELLED + ' table')})) end flush from ({step}) q2"""
    own_label = f"case when opens and tag = 'img' then {label} when ended then case when header then 'Header row' else 'Row' end when tag = 'table' then '' end"
    own_text = f"""case when opens and tag = 'img' then {text} when ended then array_to_string(cells, ', ') when opens and tag = 'table' then 'Table starts.'
      when tag = 'table' then 'Table ends, ' || cast(n_rows as varchar) || ' rows and ' || cast(n_cols as varchar) || ' columns.' end"""
    return f"""select doc_id, cast(0 as bigint) n, '' buf, cast(null as varchar) label, cast(null as varchar) link, cast(null as varchar[]) cells, false header, cast(0 as bigint) n_rows, cast(0 as bigint) n_cols, cast(0 as bigint) pics,
        cast(null as varchar) line_label, cast(null as varchar) line, cast(null as varchar) own_label, cast(null as varchar) own from (select distinct doc_id from outline_numbered) b
      union all select doc_id, n + 1, case when flush or cell then '' else buf || coalesce(said, '') || case when tag = 'br' then ' ' when tag = 'a' and kind = 'close' then coalesce({_link_mark('link')}, '') else '' end end,
        case when opens and flush then {_label('tag')} when flush or cell then null else label end, case when tag = 'a' then case when opens then href end else link end,
        case when opens and tag = 'tr' or (opens and tag in ('td', 'th') and cells is null) then cast([] as varchar[]) when cell then list_append(cells, body) when ended then null else cells end,
        case when opens and tag = 'tr' then false when opens and tag = 'th' then true else header end, case when opens and tag = 'table' then 0 when ended then n_rows + 1 else n_rows end,
        case when opens and tag = 'table' then 0 when ended then greatest(n_cols, len(cells)) else n_cols end, pics + case when opens and tag = 'img' then 1 else 0 end,
        coalesce(label, 'Text'), case when flush and body <> '' then body end, {own_label}, {own_text} from ({step}) z"""


@view
def outline_numbered(d: Spark) -> str:
    return "select *, row_number() over (partition by doc_id order by pos) n from outline_tokens"


@view
def outline(d: Spark) -> str:
    """(doc_id, line_no, label, text): a line for every block that holds text, every picture, and every table's start, rows and end."""
    if d.name == "duck":
        return f"""select doc_id, row_number() over (partition by doc_id order by n, part) line_no, label, text from (
          select doc_id, n, 0 part, line_label label, line text from outline_states where line is not null union all select doc_id, n, 1, own_label, own from outline_states where own is not null
          union all select doc_id, max(n), 2, arg_max(coalesce(label, 'Text'), n), arg_max({squeeze(d, 'buf')}, n) from outline_states group by doc_id) o where text <> '' or part = 1"""
    piece = "case when kind = 'text' then said when tag = 'br' then ' ' else mark end"
    label, text = _picture(d, "pictures")
    first = lambda c: f"min_by({c}, pos) {c}"
    runs = f"""select doc_id, run, {', '.join(first(c) for c in ('kind', 'tag', 'active', 'header', 'tbl', 'row_at', 'pictures', 'alt', 'has_alt', 'role', 'hidden', 'alt_source', 'boundary'))}, coalesce({squeeze(d, d.join(piece, '', 'pos'))}, '') body
      from ({_outline_runs()}) r group by doc_id, run"""
    cell = "(kind = 'close' and tag in ('td', 'th') and active and boundary)"
    ended = "(kind = 'close' and tag = 'tr' and active and boundary)"
    # the run before a cell's close holds its text
    told = f"""select *, {cell} is_cell, {ended} ended, coalesce(lead({cell}) over (partition by doc_id order by run), false) in_cell, lag(body) over (partition by doc_id order by run) before from ({runs}) a"""
    rows = f"""select *, collect_list(case when is_cell then before end) over (partition by doc_id, row_at) cells from ({told}) b"""
    counts = "over (partition by doc_id, tbl order by run rows between unbounded preceding and current row)"
    sums = f"select *, sum(case when ended then 1 else 0 end) {counts} n_rows, coalesce(max(case when ended then size(cells) end) {counts}, 0) n_cols from ({rows}) c"
    own = f"""case when boundary and tag = 'img' and kind <> 'close' then named_struct('label', {label}, 'text', {text}) when ended then named_struct('label', case when header then 'Header row' else 'Row' end, 'text', array_join(cells, ', '))
      when tag = 'table' and kind <> 'close' then named_struct('label', '', 'text', 'Table starts.') when tag = 'table' then named_struct('label', '', 'text', concat('Table ends, ', n_rows, ' rows and ', n_cols, ' columns.')) end"""
    block = f"case when body <> '' and not in_cell then named_struct('label', coalesce(case when boundary and kind = 'open' then {_label('tag')} end, 'Text'), 'text', body) end"
    return f"""select doc_id, row_number() over (partition by doc_id order by run, part) line_no, line.label label, line.text text from (
      select doc_id, run, posexplode(array({own}, {block})) as (part, line) from ({sums}) s) e where line is not null"""


@operator
def outline_lines(d: Spark) -> str:
    return "select doc_id, line_no, label, text from outline"


@operator
def word_counts(d: Spark) -> str:
    """Words of the blocks; marks of links, pictures and tables do not count."""
    own = d.sub("text", r"\(link to [^)]*\)")
    return f"select doc_id, cast(sum(case when label = '' or label in ('Row', 'Header row') or label like 'Picture %' then 0 else {d.count(own, '[^ ]+')} end) as bigint) words, count(*) lines from outline group by doc_id"


@operator
def word_counts_by_source(d: Spark) -> str:
    """Smallest, largest and mean size by language and source."""
    n = d.count("coalesce(text, '')", r"[^ \t\n\r\f\v]+")
    return f"select lang, source, count(*) docs, min(n) least, max(n) most, avg(cast(n as double)) mean from (select lang, source, {n} n from documents) t group by lang, source"


@operator
def word_percentiles(d: Spark) -> str:
    """Median and 95th percentile of the words of a text by language and source, exact. Spark counts the texts of each size first and
    ranks sizes; the check ranks every row."""
    sized = f"(select lang, source, {d.count("coalesce(text, '')", r'[^ \t\n\r\f\v]+')} n from documents) t"
    if d.name == "duck":
        at = lambda p: f"max(case when i = greatest(1, cast(ceil({p} * docs) as bigint)) then n end)"
        return f"select lang, source, count(*) docs, {at(0.5)} p50, {at(0.95)} p95 from (select *, row_number() over (partition by lang, source order by n) i, count(*) over (partition by lang, source) docs from {sized}) r group by lang, source"
    at = lambda p: f"min(case when upto >= greatest(1, cast(ceil({p} * docs) as bigint)) then n end)"
    return f"""select lang, source, max(docs) docs, {at(0.5)} p50, {at(0.95)} p95 from (
      select *, cast(sum(docs_of_n) over (partition by lang, source order by n) as bigint) upto, cast(sum(docs_of_n) over (partition by lang, source) as bigint) docs from (
        select lang, source, n, count(*) docs_of_n from {sized} group by lang, source, n) c) r group by lang, source"""


@view
def fx_word_limit(d: Spark) -> str:
    return "select 50 words"


@operator
def first_words(d: Spark) -> str:
    """The outline up to so many words (``fx_word_limit``); the line at the cut holds what is left of it."""
    cut = "slice(parts, 1, cast(least(n, most - before) as int))" if d.name == "spark" else "parts[1:least(n, most - before)]"
    return f"""select doc_id, line_no, label, {d.array_join(cut, ' ')} text from (
      select *, (select max(words) from fx_word_limit) most, coalesce(sum(n) over (partition by doc_id order by line_no rows between unbounded preceding and 1 preceding), 0) before from (
        select doc_id, line_no, label, {d.split('text', ' +')} parts, {d.count('text', '[^ ]+')} n from outline) a) b where before < most or (before = most and n = 0)"""


@operator
def picture_inventory(d: Spark) -> str:
    """Each picture with its state, its description cut at 90 characters, and its caption."""
    return f"""select p.doc_id, p.ordinal, case when p.needs_alt then 'please check' when p.has_alt and trim(coalesce(p.alt, '')) = '' then 'decorative' when not p.has_alt then 'none'
        when p.alt_source like 'ai%' then 'by a model' when p.alt_source = 'pdf' then 'recovered' else 'described' end state, substr(coalesce(p.alt, ''), 1, 90) text, coalesce(c.caption, '') caption
      from fx_pictures p left join fx_captions c on c.doc_id = p.doc_id and c.ordinal = p.ordinal"""


@operator
def picture_context(d: Spark) -> str:
    """The heading a picture stands under, the last one that has text, and the last 400 characters of the nearest block before it that has
    any. A picture stands after the block of its number."""
    w = "over (partition by doc_id order by ordinal, part rows between unbounded preceding and current row)"
    return f"""select doc_id, ordinal, coalesce(heading, '') heading, coalesce(before, '') before from (
      select doc_id, ordinal, part, max_by(text, case when text <> '' and level is not null then ordinal end) {w} heading, max_by(right(text, 400), case when text <> '' then ordinal end) {w} before from (
        select doc_id, ordinal, 0 part, level, trim(coalesce(text, '')) text from fx_blocks union all select doc_id, ordinal, 1, null, '' from fx_pictures) b) c where part = 1"""


# Pictures, and kilobytes of them, that go at most.
PICTURE_CAP, BUDGET_KB = 12, 12 * 1024.0
# End of fixed values.


def _payload(cap: int, budget: float) -> str:
    """Pictures taken in order. Once the cap is full all others are over it; one that cannot be read is never counted; one that would pass the budget is skipped (never the first), and the next is tried."""
    fold = f"""aggregate(pics, named_struct('n', 0, 'kb', cast(0 as double), 'out', cast(array() as array<struct<ordinal:int,verdict:string>>)),
      (acc, x) -> case when acc.n >= {cap} then named_struct('n', acc.n, 'kb', acc.kb, 'out', concat(acc.out, array(named_struct('ordinal', x.ordinal, 'verdict', 'over cap'))))
        when not x.readable then named_struct('n', acc.n, 'kb', acc.kb, 'out', concat(acc.out, array(named_struct('ordinal', x.ordinal, 'verdict', 'unreadable'))))
        when acc.n > 0 and acc.kb + x.kb > {budget} then named_struct('n', acc.n, 'kb', acc.kb, 'out', concat(acc.out, array(named_struct('ordinal', x.ordinal, 'verdict', 'over budget'))))
        else named_struct('n', acc.n + 1, 'kb', acc.kb + x.kb, 'out', concat(acc.out, array(named_struct('ordinal', x.ordinal, 'verdict', 'chosen')))) end, acc -> acc.out)"""
    return f"select doc_id, inline({fold}) from (select doc_id, array_sort(collect_list(named_struct('ordinal', cast(ordinal as int), 'kb', cast(kb as double), 'readable', readable))) pics from fx_pictures group by doc_id) p"


def _payload_steps(cap: int, budget: float) -> str:
    """The same, a step a picture."""
    step = lambda n, kb: f"case when {n} >= {cap} then 'over cap' when not p.readable then 'unreadable' when {n} > 0 and {kb} + p.kb > {budget} then 'over budget' else 'chosen' end"
    first = step("0", "cast(0 as double)")
    return f"""with recursive ordered as (select doc_id, cast(ordinal as int) ordinal, cast(kb as double) kb, readable, row_number() over (partition by doc_id order by ordinal) i from fx_pictures),
      taken as (select doc_id, i, ordinal, {first} verdict, case when {first} = 'chosen' then 1 else 0 end n, case when {first} = 'chosen' then kb else cast(0 as double) end kb from ordered p where i = 1
        union all select p.doc_id, p.i, p.ordinal, {step('t.n', 't.kb')}, t.n + case when {step('t.n', 't.kb')} = 'chosen' then 1 else 0 end, t.kb + case when {step('t.n', 't.kb')} = 'chosen' then p.kb else 0 end
        from ordered p join taken t on t.doc_id = p.doc_id and p.i = t.i + 1)
      select doc_id, ordinal, verdict from taken"""


@operator
def picture_payload(d: Spark) -> str:
    return _payload(PICTURE_CAP, BUDGET_KB) if d.name == "spark" else _payload_steps(PICTURE_CAP, BUDGET_KB)


@operator
def payload_size(d: Spark) -> str:
    """Bytes of readable pictures and of text, as kilobytes."""
    size = "octet_length(text)" if d.name == "spark" else "strlen(text)"
    return f"""select p.doc_id, (p.n + coalesce(t.n, 0)) / cast(1024 as double) kilobytes from (select doc_id, sum(case when readable then cast(round(cast(kb as double) * 1024) as bigint) else 0 end) n from fx_pictures group by doc_id) p
      left join (select doc_id, {size} n from documents) t on t.doc_id = p.doc_id"""


@operator
def alt_cleanup(d: Spark) -> str:
    """Descriptions without quotes, asterisks or an opening "image of", and those that stand on several pictures."""
    plain = squeeze(d, d.sub("alt", '["*]'))
    bare = d.sub(plain, r"(?i)^(an? )?(image|picture|photo) (of|showing) ")
    return f"select alt_clean, count(*) n, count(distinct doc_id) docs from (select doc_id, {d.upper(f'substr({bare}, 1, 1)')} || substr({bare}, 2) alt_clean from fx_pictures where trim(coalesce(alt, '')) <> '') a group by alt_clean having count(*) > 1"


@operator
def alt_provenance(d: Spark) -> str:
    """Descriptions by a model, recovered, by people and missing, by source; pictures of documents without one stand under an empty name."""
    return """select coalesce(s.source, '') source, count_if(alt_source like 'ai%' and trim(coalesce(alt, '')) <> '') ai, count_if(alt_source = 'pdf' and trim(coalesce(alt, '')) <> '') recovered,
      count_if(alt_source = '' and trim(coalesce(alt, '')) <> '') human, count_if(trim(coalesce(alt, '')) = '') missing from fx_pictures p left join fx_sources s on s.doc_id = p.doc_id group by coalesce(s.source, '')"""


@operator
def corpus_find(d: Spark) -> str:
    """Hits of each literal term in each document that has it, with or without regard to case, one after the other. All terms go over a
    text in one pass of the table; the work is that of one plain search a term."""
    if d.name == "duck":
        fold = lambda s: f"case when t.match_case then {s} else lower({s}) end"
        return f"select doc_id, term, match_case, hits from (select doc_id, term, match_case, cast(len(string_split({fold('x.text')}, {fold('t.term')})) - 1 as bigint) hits from documents x join fx_terms t on t.term <> '') h where hits > 0"
    within = lambda text, term: f"cast((length({text}) - length(replace({text}, {term}, ''))) / length({term}) as bigint)"
    hit = f"named_struct('term', t.term, 'match_case', t.match_case, 'hits', case when t.match_case then {within('text', 't.term')} else {within('low', 't.low')} end)"
    terms = "(select collect_list(named_struct('term', term, 'low', lower(term), 'match_case', match_case)) from fx_terms where term <> '')"
    return f"""select doc_id, h.term term, h.match_case match_case, h.hits hits from (
      select doc_id, explode(filter(transform(terms, t -> {hit}), t -> t.hits > 0)) h from (select doc_id, text, lower(text) low, {terms} terms from documents) x) e"""


@operator
def corpus_replace(d: Spark) -> str:
    """Each replacement in text tokens alone: how often, and the text after it. Without regard to case a hit in capitals gets capitals and
    one with a capital first gets such; the pattern is the term taken letter by letter."""
    first = lambda s: f"substr({s}, 1, 1)"
    hit, repl = ("h", "r.repl") if d.name == "spark" else ("h", "repl")
    own = "r." if d.name == "spark" else ""
    copied = f"""case when {own}match_case then {repl} when {hit} = {d.upper(hit)} and {hit} <> lower({hit}) and length({hit}) > 1 then {d.upper(repl)}
      when {first(hit)} = {d.upper(first(hit))} and {first(hit)} <> lower({first(hit)}) then {d.upper(first(repl))} || substr({repl}, 2) else {repl} end"""
    if d.name == "duck":
        pattern = "case when match_case then '' else '(?i)' end || '\\Q' || find || '\\E'"
        return f"""with t as (select k.doc_id, k.pos, f.find, f.repl, f.match_case, string_split_regex(k.tok, {pattern}) pieces, regexp_extract_all(k.tok, {pattern}) hits from tokens k join fx_replacements f on f.find <> '' where k.kind = 'text'),
          u as (select doc_id, pos, find, len(hits) n, list_transform(hits, lambda h: {copied}) news, pieces from t),
          v as (select doc_id, pos, find, n, array_to_string(list_transform(range(1, len(pieces) + 1), lambda i: pieces[i] || coalesce(news[i], '')), '') body from u)
          select doc_id, find, cast(sum(n) as bigint) n, md5(string_agg(body, '' order by pos)) text_md5 from v group by doc_id, find having sum(n) > 0"""
    pattern = r"concat(if(r.match_case, '', '(?iu)'), '\\Q', replace(r.find, '\\E', '\\E\\\\E\\Q'), '\\E')"
    return f"""select doc_id, find, cast(sum(n) as bigint) n, md5({d.join('body', '', 'pos')}) text_md5 from (
      select doc_id, pos, r.find find, size(hits) n, array_join(zip_with(pieces, transform(hits, h -> {copied}), (p, h) -> concat(p, coalesce(h, ''))), '') body from (
        select doc_id, pos, r, split(tok, {pattern}, -1) pieces, regexp_extract_all(tok, {pattern}, 0) hits from (
          select doc_id, pos, tok, explode((select collect_list(named_struct('find', find, 'repl', repl, 'match_case', match_case)) from fx_replacements where find <> '')) r from tokens where kind = 'text') a) b) c
      group by doc_id, find having sum(n) > 0"""


@operator
def dash_report(d: Spark) -> str:
    """Lines with dashes, and how they read without: ranges with "to", others with a comma."""
    clean = d.sub(d.sub("line", "([0-9]) *[–—] *([0-9])", r"\1 to \2"), " *[–—] *", ", ")
    return f"select doc_id, line_no, {d.count('line', '[–—]')} dashes, {clean} cleaned from fx_dash_lines where {d.like('line', '[–—]')}"
