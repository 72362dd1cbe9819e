"""Positioned text back to blocks: furniture, headings, lists, paragraphs, columns, tables and pictures."""

from __future__ import annotations

from marginalia.functions.dialect import Spark

from .base import banded, meet, operator, squeeze, stored, view
from .report import followed

# List marks, ends of sentences, stop words of two languages.
BULLET = "[•◦▪●○■‣⁃·*–—-]"
NUMBER = r"\(?([0-9]{1,3}|[a-zA-Z]|[ivxIVX]{1,6})[.)]"
SENTENCE_END = r"""[.!?:;"”’)\]]\s*$"""
SPANISH = "de la que el en y a los del se las por un para con no una su al lo como"
ENGLISH = "the of and to in a is that for it as was with be by on not he his but at"
# End of fixed values.


def furniture_key(d: Spark, s: str) -> str:
    return f"lower({d.sub(squeeze(d, s), '[0-9]+', '#')})"


@view
def margin_lines(d: Spark) -> str:
    """Lines that lie wholly in the top or bottom tenth of their page."""
    return f"select l.*, {furniture_key(d, 'l.text')} key from fx_lines l join fx_line_pages p on p.doc_id = l.doc_id and p.page = l.page where l.y1 <= 0.1 * p.height or l.y0 >= 0.9 * p.height"


@view
def furniture(d: Spark) -> str:
    """Margin keys on at least half of the pages of a document of two pages or more."""
    return """select k.doc_id, k.key, k.pages from (select doc_id, key, count(distinct page) pages from margin_lines where length(key) between 1 and 89 group by doc_id, key) k
      join (select doc_id, count(distinct page) n from fx_line_pages group by doc_id) p on p.doc_id = k.doc_id
      where p.n >= 2 and k.pages >= greatest(2, cast(floor(p.n * 0.5 + 0.5) as bigint))"""


@operator
def furniture_lines(d: Spark) -> str:
    return "select doc_id, key, pages from furniture"


@view
def dropped_lines(d: Spark) -> str:
    first = d.array_join(d.collect("text", "n", "n <= 3"), " | ")
    return f"""select doc_id, cast(sum(lines) as bigint) dropped, {first} examples from (
      select doc_id, text, lines, row_number() over (partition by doc_id order by first_at) n from (
        select m.doc_id, m.text, count(*) lines, min({d.struct(page='m.page', line='m.line')}) first_at from margin_lines m join furniture f on f.doc_id = m.doc_id and f.key = m.key group by m.doc_id, m.text) a) b group by doc_id"""


@operator
def drop_furniture(d: Spark) -> str:
    """How many lines go, and the first three different ones."""
    return "select doc_id, dropped, examples from dropped_lines"


@operator
def source_boilerplate(d: Spark) -> str:
    """Lines that repeat over the documents of a source."""
    return f"""select source, key, docs from (select source, key, count(distinct doc_id) docs from (
      select source, doc_id, {furniture_key(d, 'text')} key from fx_doc_lines) k where length(key) between 1 and 89 group by source, key) c where docs >= 2"""


def commonest(d: Spark, source: str, key: str, size: str, n: str, name: str) -> str:
    """(key, name): the size with the most characters; on a tie the one that came first by page, line and span."""
    first = d.struct(page="page", line="line", span="span")
    return f"""select {key}, size {name} from (select *, row_number() over (partition by {key} order by n desc, first_at) best from (
      select {key}, {size} size, sum(length({n})) n, min({first}) first_at from {source} group by {key}, {size}) s) r where best = 1"""


@view
def body_sizes(d: Spark) -> str:
    """The commonest size by characters, to the half point."""
    return commonest(d, "fx_spans", "doc_id", f"{d.even('size * 2')} / 2", "trim(text)", "body")


@operator
def body_size(d: Spark) -> str:
    return "select doc_id, cast(body as double) body_size from body_sizes"


@view
def big_sizes(d: Spark) -> str:
    half = f"{d.even('s.size * 2')} / 2"
    return f"""select doc_id, size, least(dense_rank() over (partition by doc_id order by size desc), 3) level from (
      select distinct s.doc_id, {half} size, b.body from fx_spans s join body_sizes b on b.doc_id = s.doc_id) t where size >= body * 1.15"""


@operator
def heading_sizes(d: Spark) -> str:
    return "select doc_id, cast(size as double) size, cast(level as int) level from big_sizes"


@view
def leveled(d: Spark) -> str:
    """A block's level by its dominant size; 4 for a single short bold line that ends no sentence."""
    half = f"{d.even('size * 2')} / 2"
    return f"""select b.doc_id, b.page, b.block, coalesce(h.level, case when b.lines = 1 and b.bold and length(b.text) < 80 and not {d.like('b.text', SENTENCE_END)} and b.size >= 0.95 * z.body then 4 end) level, b.text from (
        select doc_id, page, block, max_by(size, {d.struct(n='n', size='size')}) size, max(lines) lines, bool_and(bold) bold, max(text) text from (
          select s.doc_id, s.page, s.block, {half} size, sum(length(trim(s.text))) n, bool_and(s.bold) bold, max(t.lines) lines, max(t.text) text from fx_spans s
          join (select doc_id, page, block, count(*) lines, {d.join('text', ' ', 'line')} text from fx_lines group by doc_id, page, block) t on t.doc_id = s.doc_id and t.page = s.page and t.block = s.block
          group by s.doc_id, s.page, s.block, {half}) q group by doc_id, page, block) b
      join body_sizes z on z.doc_id = b.doc_id left join big_sizes h on h.doc_id = b.doc_id and h.size = b.size"""


@operator
def block_levels(d: Spark) -> str:
    return "select doc_id, page, block, cast(level as int) level from leveled"


@operator
def heading_renumber(d: Spark) -> str:
    """A document's distinct levels become 1, 2, 3.."""
    return "select doc_id, page, block, cast(dense_rank() over (partition by doc_id order by level) as int) level from leveled where level is not null"


def _beside(d: Spark, lines: str, shapes: str) -> str:
    """Lines with small filled shapes, of 0.5 to 8 points either way, beside them that end at most 30 points left of the line and 1 point in it."""
    small = f"(select * from {shapes} where x1 - x0 between 0.5 and 8 and y1 - y0 between 0.5 and 8) b"
    return f"""select l.doc_id, l.page, l.line, count(*) shapes from {banded(d, lines, 'y0', 'y1')} l join {banded(d, small, 'y0', 'y1')} s
      on s.doc_id = l.doc_id and s.page = l.page and {meet(d, 'l', 's')} and s.x1 >= l.x0 - 30 and s.x1 <= l.x0 + 1 and s.y0 < l.y1 and s.y1 > l.y0 group by l.doc_id, l.page, l.line"""


@view
def marked_lines(d: Spark) -> str:
    """Lines with their list mark, written or drawn; a written one is cut."""
    bullet, number = rf"^\s*{BULLET}\s+", rf"^\s*{NUMBER}\s+"
    return f"""select doc_id, page, block, line, case when {d.like('text', bullet)} then 'ul' when {d.like('text', number)} then 'ol' when shapes > 0 then 'ul' end marker,
      case when {d.like('text', bullet)} then {d.sub('text', bullet)} when {d.like('text', number)} then {d.sub('text', number)} else text end text
      from (select l.doc_id, l.page, l.block, l.line, l.text, b.shapes from fx_lines l left join ({_beside(d, 'fx_lines', 'fx_line_shapes')}) b on b.doc_id = l.doc_id and b.page = l.page and b.line = l.line) m"""


@operator
def list_markers(d: Spark) -> str:
    return "select doc_id, page, line, marker, text from marked_lines where marker is not null"


@operator
def drawn_bullets(d: Spark) -> str:
    """Lines with a drawn bullet beside them."""
    return _beside(d, "fx_form_lines", "fx_bullet_shapes")


@operator
def list_items(d: Spark) -> str:
    """A marked line opens an item, the unmarked lines of its block go on with it; neighbours of one kind form a list. What stands between items ends a list."""
    return f"""select doc_id, page, block, item_id, list_id, tag, text from (select *, sum(case when tag = coalesce(before, '') then 0 else 1 end) over (partition by doc_id order by page, block, item_id rows between unbounded preceding and current row) list_id from (
      select *, lag(tag) over (partition by doc_id order by page, block, item_id) before from (
        select doc_id, page, block, cast(item as bigint) item_id, coalesce(max(marker), 'none') tag, {squeeze(d, d.join('text', ' ', 'line'))} text from (
          select *, sum(case when marker is not null then 1 else 0 end) over (partition by doc_id, page, block order by line rows between unbounded preceding and current row) item from marked_lines) m
        group by doc_id, page, block, item) i) j) k where tag <> 'none'""".replace("sum(case when tag = coalesce(before, '') then 0 else 1 end) over (partition by doc_id order by page, block, item_id rows between unbounded preceding and current row)", "cast(sum(case when tag = coalesce(before, '') then 0 else 1 end) over (partition by doc_id order by page, block, item_id rows between unbounded preceding and current row) as bigint)")


@view
def joined_lines(d: Spark) -> str:
    """A block's lines as one text; a hyphen at a line's end is healed where the next line starts lower-case."""
    piece = f"case when healed then substr(text, 1, length(text) - 1) when last_line then text else text || ' ' end"
    return f"""select doc_id, page, block, {squeeze(d, d.join(piece, '', 'line'))} text from (
      select *, coalesce({d.like('text', '-$')} and {d.like('following', r'^\s*\p{Ll}')}, false) healed, following is null last_line from (
        select doc_id, page, block, line, text, lead(text) over (partition by doc_id, page, block order by line) following from fx_lines) a) b group by doc_id, page, block"""


@operator
def line_join(d: Spark) -> str:
    return "select doc_id, page, block, text from joined_lines"


@operator
def paragraph_continuation(d: Spark) -> str:
    """A block goes on with the one before where that ends no sentence and this starts lower-case."""
    goes_on = f"not {d.like('before', SENTENCE_END)} and {d.like('text', r'^\p{Ll}')}"
    return f"""select doc_id, cast(para as bigint) para_id, {d.join('text', ' ', 'page, block')} text from (
      select *, sum(case when before is not null and {goes_on} then 0 else 1 end) over (partition by doc_id order by page, block rows between unbounded preceding and current row) para from (
        select *, lag(text) over (partition by doc_id order by page, block) before from joined_lines) a) b group by doc_id, para"""


@operator
def reading_order(d: Spark) -> str:
    """Two columns are read left, then right, between full-width lines; other pages in content order. A line is full-width from 0.55 of its
    page's width on, and in a column if it keeps within 12 points of the middle."""
    return """select doc_id, page, line, row_number() over (partition by doc_id, page order by case when two then band end, case when two then side end, case when two then y0 end, line) read_ord from (
      select *, sum(case when side = 1 then 1 else 0 end) over (partition by doc_id, page order by y0, line rows between unbounded preceding and current row) band,
             bool_and(side > 0 or narrow) over (partition by doc_id, page) and max(case when side = 2 then 1 else 0 end) over (partition by doc_id, page) = 1 and max(case when side = 3 then 1 else 0 end) over (partition by doc_id, page) = 1 two
      from (select l.doc_id, l.page, l.line, l.y0, l.x1 - l.x0 < 0.55 * p.width narrow, case when l.x1 - l.x0 >= 0.55 * p.width then 1 when l.x1 <= p.width / 2 + 12 then 2 when l.x0 >= p.width / 2 - 12 then 3 else 0 end side
            from fx_lines l join fx_line_pages p on p.doc_id = l.doc_id and p.page = l.page) a) b"""


@operator
def span_merge(d: Spark) -> str:
    """Neighbouring spans of equal format (bold, italic, mono, superscript, link) become one run; in a heading bold is no format. A span has
    the first link whose rectangle holds its centre; spans without text are none."""
    centre = "(y0 + y1) / 2"
    linked = f"""select s.doc_id, s.page, s.line, s.span, min_by(r.uri, r.link_id) uri from {banded(d, 'fx_formatted_spans', centre, centre)} s join {banded(d, 'fx_link_rects', 'y0', 'y1')} r
      on r.doc_id = s.doc_id and r.page = s.page and {meet(d, 's', 'r')} and (s.x0 + s.x1) / 2 between r.x0 and r.x1 and (s.y0 + s.y1) / 2 between r.y0 and r.y1 group by s.doc_id, s.page, s.line, s.span"""
    w = "over (partition by doc_id, page, line order by span)"
    formats = "bold italic mono superscript link".split()
    same = " and ".join(f"lag({c}) {w} = {c}" for c in formats)
    return f"""select doc_id, page, line, cast(run as bigint) run_id, {', '.join(formats)}, {d.join('text', '', 'span')} text from (
      select *, sum(case when same then 0 else 1 end) over (partition by doc_id, page, line order by span rows between unbounded preceding and current row) run from (
        select *, coalesce({same}, false) same from (
          select s.doc_id, s.page, s.line, s.span, s.text, s.bold and h.level is null bold, s.italic, s.mono, s.superscript, coalesce(u.uri, '') link from fx_formatted_spans s
          left join leveled h on h.doc_id = s.doc_id and h.page = s.page and h.block = s.block left join ({linked}) u on u.doc_id = s.doc_id and u.page = s.page and u.line = s.line and u.span = s.span
          where s.text <> '') a) b) c group by doc_id, page, line, run, {', '.join(formats)}"""


@view
def words_in_links(d: Spark) -> str:
    return f"""select w.doc_id, w.page, w.word_id, w.text, r.link_id, r.uri from {banded(d, 'fx_line_words', '(y0 + y1) / 2', '(y0 + y1) / 2')} w join {banded(d, 'fx_link_rects', 'y0', 'y1')} r on r.doc_id = w.doc_id and r.page = w.page and {meet(d, 'w', 'r')}
      and (w.x0 + w.x1) / 2 between r.x0 and r.x1 and (w.y0 + w.y1) / 2 between r.y0 and r.y1"""


@operator
def span_links(d: Spark) -> str:
    """A word takes the first link whose rectangle holds its centre."""
    return "select doc_id, page, word_id, min_by(uri, link_id) uri from words_in_links group by doc_id, page, word_id"


@operator
def table_text_removal(d: Spark) -> str:
    """Lines whose centre lies in a table leave the flow."""
    return f"""select l.doc_id, l.page, l.line from fx_form_lines l left join (
        select distinct l.doc_id, l.page, l.line from {banded(d, 'fx_form_lines', '(y0 + y1) / 2', '(y0 + y1) / 2')} l join {banded(d, 'fx_table_boxes', 'y0', 'y1')} t on t.doc_id = l.doc_id and t.page = l.page and {meet(d, 'l', 't')}
        and (l.x0 + l.x1) / 2 between t.x0 and t.x1 and (l.y0 + l.y1) / 2 between t.y0 and t.y1) i on i.doc_id = l.doc_id and i.page = l.page and i.line = l.line where i.doc_id is null"""


@operator
def table_rows(d: Spark) -> str:
    """Cells as rows, the first as header; tables of at least two by two."""
    return f"""select doc_id, tbl, r, c, case when r = min(r) over (partition by doc_id, tbl) then 'th' else 'td' end tag, {squeeze(d, 'text')} text from (
      select *, max(r) over (partition by doc_id, tbl) mr, max(c) over (partition by doc_id, tbl) mc from fx_cells) t where mr >= 1 and mc >= 1"""


@operator
def picture_filter(d: Spark) -> str:
    """Pictures large enough to matter; on recognised pages not those that cover three quarters of the page."""
    return """select p.doc_id, p.page, p.ordinal from fx_pictures p left join (select distinct doc_id, page from fx_recognised) r on r.doc_id = p.doc_id and r.page = p.page
      left join fx_form_pages g on g.doc_id = p.doc_id and g.page = p.page
      where w_px >= 24 and h_px >= 24 and x1 - x0 >= 6 and y1 - y0 >= 6 and not (r.doc_id is not null and coalesce((x1 - x0) * (y1 - y0) >= 0.75 * g.width * g.height, false))"""


@operator
def picture_placement(d: Spark) -> str:
    """A picture goes before the first line that starts below its top."""
    return """select p.doc_id, p.page, p.ordinal, min(l.line) before_line from fx_pictures p left join fx_form_lines l on l.doc_id = p.doc_id and l.page = p.page and l.y0 >= p.y0 group by p.doc_id, p.page, p.ordinal"""


@stored
def tagged_counts(d: Spark) -> str:
    return """select coalesce(p.doc_id, a.doc_id) doc_id, coalesce(p.page, a.page) page, coalesce(p.n, 0) pictures, coalesce(a.n, 0) alts from
      (select doc_id, page, count(*) n from fx_pictures where in_tagged group by doc_id, page) p full outer join (select doc_id, page, count(*) n from fx_figure_alts group by doc_id, page) a on a.doc_id = p.doc_id and a.page = p.page"""


@view
def alt_matches(d: Spark) -> str:
    return """select p.doc_id, p.page, p.ordinal, a.alt from (select doc_id, page, ordinal, row_number() over (partition by doc_id, page order by ordinal) n from fx_pictures where in_tagged) p
      join tagged_counts c on c.doc_id = p.doc_id and c.page = p.page and c.pictures = c.alts
      join (select doc_id, page, alt, row_number() over (partition by doc_id, page order by seq) n from fx_figure_alts) a on a.doc_id = p.doc_id and a.page = p.page and a.n = p.n"""


@operator
def alt_matching(d: Spark) -> str:
    """Descriptions go to a page's tagged pictures by position, where there are as many of either."""
    return "select doc_id, page, ordinal, alt from alt_matches"


@operator
def alt_mismatches(d: Spark) -> str:
    """Pages whose tags describe another number of pictures than they hold; tags without descriptions are no mismatch."""
    return "select doc_id, page, pictures, alts from tagged_counts where alts > 0 and pictures <> alts"


@operator
def tagged_occurrence(d: Spark) -> str:
    """Each drawing of an object takes the next recorded mark of it; tagged ones are counted."""
    return """select doc_id, page, ordinal, in_tagged, case when in_tagged then sum(case when in_tagged then 1 else 0 end) over (partition by doc_id, page order by ordinal rows between unbounded preceding and current row) end content_index from (
      select p.doc_id, p.page, p.ordinal, coalesce(m.in_tagged, false) in_tagged from (select doc_id, page, xref, ordinal, row_number() over (partition by doc_id, page, xref order by ordinal) n from fx_pictures) p
      left join (select doc_id, page, xref, in_tagged, row_number() over (partition by doc_id, page, xref order by seq) n from fx_marks) m on m.doc_id = p.doc_id and m.page = p.page and m.xref = p.xref and m.n = p.n) t""".replace("then sum(", "then cast(sum(").replace("current row) end content", "current row) as bigint) end content")


@operator
def size_levelling(d: Spark) -> str:
    """On recognised pages sizes under 1.3 x the page's commonest become the one of the document's other pages (without any, the page's own); larger ones keep their proportion."""
    spans = "(select s.*, r.doc_id is not null recognised from fx_spans s left join (select distinct doc_id, page from fx_recognised) r on r.doc_id = s.doc_id and r.page = s.page)"
    page = commonest(d, f"{spans} q where recognised", "doc_id, page", d.even("size"), "text", "body")
    native = commonest(d, f"{spans} q where not recognised", "doc_id", f"{d.even('size * 2')} / 2", "trim(text)", "native")
    return f"""select s.doc_id, s.page, s.line, s.span, cast(case when b.body is null then s.size when s.size < 1.3 * b.body then coalesce(n.native, b.body) else s.size * coalesce(n.native, b.body) / b.body end as double) size from fx_spans s
      left join ({page}) b on b.doc_id = s.doc_id and b.page = s.page left join ({native}) n on n.doc_id = s.doc_id"""


@view
def controls(d: Spark) -> str:
    bad = r"[\x{00}-\x{08}\x{0B}\x{0C}\x{0E}-\x{1F}\x{7F}-\x{9F}\x{E000}-\x{F8FF}]"
    return f"select doc_id, {d.count('text', bad)} removed, md5({d.sub('text', bad)}) text_md5 from (select doc_id, coalesce(text, '') text from fx_control_texts) t"


@operator
def control_chars(d: Spark) -> str:
    return "select doc_id, removed, text_md5 from controls"


@view
def coverage(d: Spark) -> str:
    solid = lambda s: f"length({d.sub(s, '[ ]+')})"
    return f"""select p.doc_id, cast(e.n as double) / p.n ratio, cast(e.n as double) / p.n between 0.85 and 1.3 use_tags from
      (select doc_id, sum({solid('text')}) n from fx_pdf_pages group by doc_id having sum({solid('text')}) > 0) p join (select doc_id, sum({solid('text')}) n from fx_content group by doc_id) e on e.doc_id = p.doc_id"""


@operator
def tree_coverage(d: Spark) -> str:
    """Whether the tags hold about as much text as the pages do."""
    return "select doc_id, ratio, use_tags from coverage"


@stored
def picture_pages(d: Spark) -> str:
    """Pages by whether they are pictures of text: some picture, no text, no table, and not read by recognition."""
    pages = lambda t: f"(select distinct doc_id, page from {t})"
    return f"""select k.doc_id, k.page, k.kind = 'scanned' and t.doc_id is null and r.doc_id is null scanned, k.kind = 'blank' and t.doc_id is null blank from page_kinds k
      left join {pages('fx_table_boxes')} t on t.doc_id = k.doc_id and t.page = k.page left join {pages('fx_recognised')} r on r.doc_id = k.doc_id and r.page = k.page"""


@operator
def scanned_documents(d: Spark) -> str:
    """How many pages are pictures of text; whether all are, some are, or there is nothing at all."""
    return """select doc_id, count_if(scanned) scanned_pages, count_if(scanned) = count(*) is_scanned, count_if(scanned) between 1 and count(*) - 1 some_scanned, count_if(blank) = count(*) nothing from picture_pages group by doc_id"""


@stored
def import_ways(d: Spark) -> str:
    """Tagged documents, and whether they are read from their tags or, as these hold too little or too much, from the layout."""
    return "select e.doc_id, coalesce(c.use_tags, false) by_tags from (select distinct doc_id from fx_elems) e left join coverage c on c.doc_id = e.doc_id"


@operator
def import_warnings(d: Spark) -> str:
    """What a reader of an imported document should check, in order, with counts. Documents read from their tags are warned of what comes
    from tags, all others of what comes from the layout: pages read by recognition or garbled, running lines (three of them named),
    rebuilt tables, pages that are pictures, and descriptions matched or, on the pages named (eight at most), left unmatched."""
    pages = lambda t: f"(select distinct doc_id, page from {t})"
    unread = "r.doc_id = k.doc_id and r.page = k.page where r.doc_id is null"
    mismatched = d.array_join(d.collect("page", "page", "nth <= 8"), ", ")
    warnings = [
        ("", "fields", "count(*)", "''", "fx_fields"),
        ("true", "read from the tags", "1", "''", "import_ways"),
        ("true", "decoration left out", "count_if(not in_tagged)", "''", "fx_marks"),
        ("true", "descriptions from the tags", "count_if(trim(alt) <> '')", "''", "fx_figure_alts"),
        ("false", "tagged, but rebuilt from the layout", "1", "''", "import_ways"),
        ("false", "pages read by recognition", "count(*)", "''", f"{pages('fx_recognised')} r"),
        ("false", "garbled pages", "count_if(kind = 'garbled')", "''", f"(select k.doc_id, k.kind from page_kinds k left join {pages('fx_recognised')} r on {unread}) g"),
        ("false", "running lines left out", "max(keys)", "max(examples)", "(select l.doc_id, f.keys, l.examples from dropped_lines l join (select doc_id, count(*) keys from furniture group by doc_id) f on f.doc_id = l.doc_id) l"),
        ("false", "tables rebuilt", "count(*)", "''", f"(select k.doc_id from fx_table_boxes k left join {pages('fx_recognised')} r on {unread}) t"),
        ("false", "all pages are pictures", "case when count_if(scanned) = count(*) then count(*) else 0 end", "''", "picture_pages"),
        ("false", "some pages are pictures", "case when count_if(scanned) < count(*) then count_if(scanned) else 0 end", "''", "picture_pages"),
        ("false", "nothing on any page", "case when count_if(blank) = count(*) then count(*) else 0 end", "''", "picture_pages"),
        ("false", "descriptions from the tags", "count_if(trim(alt) <> '')", "''", "alt_matches"),
        ("false", "descriptions did not match", "count(*)", mismatched, "(select doc_id, cast(page as int) page, row_number() over (partition by doc_id order by page) nth from tagged_counts where alts > 0 and pictures <> alts) m"),
        ("", "control characters removed", "max(removed)", "''", "controls"),
    ]
    union = " union all ".join(
        f"select doc_id, {i} ord, '{name}' warning, {way or 'null'} way, cast({n} as bigint) n, {detail} detail from {source} group by doc_id" for i, (way, name, n, detail, source) in enumerate(warnings, 1)
    )
    return f"""select u.doc_id, u.ord, u.warning, u.n, u.detail from ({union}) u left join import_ways w on w.doc_id = u.doc_id
      where u.n > 0 and (u.way is null or u.way = coalesce(w.by_tags, false))"""


def guesses_of(d: Spark, source: str) -> str:
    """Stop words among the first 4,000 words; a language is named from 20 words and a share of 8% on."""
    lists = " union all ".join(f"select '{w}' word, '{lang}' lang" for lang, ws in (("es", SPANISH), ("en", ENGLISH)) for w in ws.split())
    letters = d.extract_all("lower(coalesce(text, ''))", r"\p{L}+", 0)
    return f"""select doc_id, es_hits, en_hits, words, case when words < 20 or greatest(es_hits, en_hits) < 0.08 * words then '' when es_hits > en_hits then 'es' else 'en-US' end guess from (
      select w.doc_id, count_if(s.lang = 'es') es_hits, count_if(s.lang = 'en') en_hits, count(distinct w.pos) words from ({d.each(source, letters, 'doc_id')}) w left join ({lists}) s on s.word = w.x where w.pos < 4000 group by w.doc_id) g"""


@view
def guesses(d: Spark) -> str:
    return guesses_of(d, "documents")


@operator
def language_guess(d: Spark) -> str:
    return "select doc_id, guess, es_hits, en_hits, words from guesses"


@operator
def import_metadata(d: Spark) -> str:
    """Title by the tags, else by the file's information, else the first heading of the highest level; language by the tags, else guessed;
    what nobody says is empty."""
    heading = f"(select doc_id, min_by(text, {d.struct(page='page', block='block')}) text from (select *, min(level) over (partition by doc_id) top from leveled where level is not null) l where level = top group by doc_id) h"
    return f"""select p.doc_id, coalesce(nullif(trim(p.xmp_title), ''), nullif(trim(p.info_title), ''), {squeeze(d, 'h.text')}, '') title, trim(coalesce(i.author, '')) author, trim(coalesce(i.subject, '')) subject, coalesce(nullif(trim(p.lang), ''), g.guess, '') lang
      from fx_docs p left join guesses g on g.doc_id = p.doc_id left join {heading} on h.doc_id = p.doc_id left join fx_doc_info i on i.doc_id = p.doc_id"""


# Structure types of running text, and of blocks that are taken whole.
TEXT_KINDS = "P Caption TOCI BibEntry Note Code Span Strong Em Link Reference Quote Formula"
WHOLE_KINDS = {"L": "ul", "Table": "table", "Figure": "img", "BlockQuote": "blockquote", "Form": ""}
# End of fixed values.


@stored
def elem_roles(d: Spark) -> str:
    """Spark's elements in order, each with the kind (role) that its document's role map leads to."""
    return f"""select doc_id, x.elem_id, x.parent_id, x.kind, x.enter, x.enter + x.size leave, {followed('x.kind')} role
      from (select e.doc_id, explode(e.items) x, m.roles from elem_docs e left join kind_maps m on m.doc_id = e.doc_id) e"""


@stored
def walked_elements(d: Spark) -> str:
    """Elements by the kind that the role map gives them: ``taken`` ones become a block with all they hold, others are walked through.
    ``top``: where the last block that is taken begins (Spark)."""
    slashed = lambda names: ", ".join(f"'/{n}'" for n in names.split())
    headings, blocks = slashed("H H1 H2 H3 H4 H5 H6"), slashed("L Table Figure")
    taken = f"role in ({headings}, {slashed(TEXT_KINDS)}, {slashed(' '.join(WHOLE_KINDS))}) and not (role = '/P' and h.parent_id is not null)"
    roles = "(select o.*, coalesce(r.resolved, o.kind) role from elem_order o left join role_chain r on r.doc_id = o.doc_id and r.kind = o.kind)"
    if d.name == "spark":
        inside = "coalesce(max(case when taken then leave end) over (partition by doc_id order by enter rows between unbounded preceding and 1 preceding), 0) > enter"
        return f"""select *, max(case when taken and not inside then enter end) over (partition by doc_id order by enter rows between unbounded preceding and current row) top from (select *, {inside} inside from (
          select k.doc_id, k.elem_id, k.enter, k.leave, k.role, {taken} taken from elem_roles k left join (select distinct doc_id, parent_id from elem_roles b where role in ({blocks}) and parent_id is not null) h on h.doc_id = k.doc_id and h.parent_id = k.elem_id) t) w"""
    return f"""select *, coalesce(max(case when taken then leave end) over (partition by doc_id order by enter rows between unbounded preceding and 1 preceding), 0) > enter inside from (
      select k.doc_id, k.elem_id, k.enter, k.leave, k.role, {taken} taken from {roles} k left join (select distinct doc_id, parent_id from {roles} b where role in ({blocks}) and parent_id is not null) h on h.doc_id = k.doc_id and h.parent_id = k.elem_id) t"""


@operator
def tag_blocks(d: Spark) -> str:
    """Structure elements as blocks in the order of the tree. A paragraph around a list, table or picture is walked through, like any
    grouping element; content that stands in such elements itself becomes a paragraph."""
    whole = " ".join(f"when '/{k}' then '{v}'" for k, v in WHOLE_KINDS.items())
    tag = f"case w.role when '/H' then 'h2' {' '.join(f"when '/H{i}' then 'h{i}'" for i in range(1, 7))} {whole} else 'p' end"
    if d.name == "spark":
        # a piece of content belongs to one block at most: it and the block's own row meet by the block's place, in one shuffle
        text = d.join("text", " ", "enter, page, mcid")
        loose = "not w.taken and not w.inside"
        return f"""select doc_id, row_number() over (partition by doc_id order by block, at_page, at_mcid) ord, tag, text from (
            select doc_id, block, min(at_page) at_page, min(at_mcid) at_mcid, min(tag) tag, {squeeze(d, f"coalesce({text}, '')")} text from (
              select /*+ repartition(doc_id) */ * from (
                select w.doc_id, w.top block, cast(null as bigint) alone, 0 at_page, 0 at_mcid, {tag} tag, w.enter, 0 page, 0 mcid, cast(null as string) text from walked_elements w where w.taken and not w.inside
                union all select w.doc_id, case when {loose} then w.enter else w.top end, case when {loose} then monotonically_increasing_id() end, case when {loose} then coalesce(c.page, 0) end, case when {loose} then c.mcid end,
                  case when {loose} then 'p' end, w.enter, c.page, c.mcid, c.text from walked_elements w join fx_content c on c.doc_id = w.doc_id and c.elem_id = w.elem_id) u) r
            group by doc_id, block, alone) b
          where tag in ('ul', 'table', 'img', 'blockquote') or (tag <> '' and text <> '')"""
    return f"""select doc_id, row_number() over (partition by doc_id order by enter, page, mcid) ord, tag, text from (
        select w.doc_id, w.enter, 0 page, 0 mcid, {tag} tag, coalesce(t.text, '') text from walked_elements w left join texts_below t on t.doc_id = w.doc_id and t.elem_id = w.elem_id where w.taken and not w.inside
        union all select w.doc_id, w.enter, coalesce(c.page, 0), c.mcid, 'p', {squeeze(d, "coalesce(c.text, '')")} from walked_elements w join fx_content c on c.doc_id = w.doc_id and c.elem_id = w.elem_id where not w.taken and not w.inside) b
      where tag in ('ul', 'table', 'img', 'blockquote') or (tag <> '' and text <> '')"""
