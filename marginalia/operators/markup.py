"""Rules over markup that the given pages do not hold: styles, language marks, figures and code, on pages made from them."""

from __future__ import annotations

from marginalia.functions.dialect import Spark

from .base import decoded, is_lang, operator, squeeze, view, words


@view
def styled(d: Spark) -> str:
    """A span a part, with inline styles, language marks and its block's text."""
    return """select doc_id, ordinal, level, text, case when ordinal % 4 = 0 then 'font-weight: bold' when ordinal % 4 = 1 then 'font-style:italic; text-decoration: underline' when ordinal % 4 = 2 then 'font-weight:700;text-align:CENTER'
        else 'text-decoration: line-through; width: 60%; float:right' end style, case level when 1 then 'fr' when 2 then 'not a code' when 3 then 'de-AT' else '' end lang, case when ordinal % 3 = 0 then text else text || ' and more' end block_text from fx_headings"""


def _style(d: Spark, name: str) -> str:
    return f"lower(trim({d.extract('style', rf'(?i)(?:^|;)\s*{name}\s*:\s*([^;]+)', 1)}))"


@operator
def style_folding(d: Spark) -> str:
    """Inline styles as meaning: emphasis elements, and classes for alignment, width and place."""
    weight, width = _style(d, "font-weight"), d.number(d.extract(_style(d, "width"), "^([0-9.]+)%$", 1))
    wrappers = d.array_join(
        d.compact(
            f"case when {weight} in ('bold', 'bolder') or {d.number(weight)} >= 600 then 'strong' end",
            f"case when {_style(d, 'font-style')} in ('italic', 'oblique') then 'em' end",
            f"case when {_style(d, 'text-decoration')} like '%underline%' then 'u' end",
            f"case when {_style(d, 'text-decoration')} like '%line-through%' then 's' end",
        ),
        ",",
    )
    return f"""select doc_id, ordinal, {wrappers} wrappers, case {_style(d, 'text-align')} when 'left' then 'align-left' when 'center' then 'align-center' when 'right' then 'align-right' when 'justify' then 'align-justify' else '' end align,
      case when {width} is null then '' when {width} < 37.5 then 'width-quarter' when {width} < 62.5 then 'width-half' when {width} < 87.5 then 'width-three-quarters' else 'width-full' end width,
      case {_style(d, 'float')} when 'left' then 'place-left' when 'right' then 'place-right' else '' end place from styled"""


@operator
def lang_hoist(d: Spark) -> str:
    """A span's language moves to its block where the span is the whole block's text; bad codes go."""
    bare = lambda s: d.sub(s, r"[ \t\n\r\f\v]+")
    return f"""select doc_id, ordinal, lang, case when not {is_lang(d, 'lang')} then 'bad code' when {bare('text')} = {bare('block_text')} then 'hoisted' else 'dropped' end verdict from styled where lang <> ''"""


@view
def figure_tokens(d: Spark) -> str:
    """Tokens of pages with figures: the figure that each stands in, its caption, and how many captions the figure has had by then."""
    from .html import tokens_of, undropped_of

    last = lambda tag, kind: f"max(case when tag = '{tag}' and kind = '{kind}' then pos end) over (partition by doc_id order by pos rows between unbounded preceding and current row)"
    tokens = undropped_of(d, f"({tokens_of(d, 'fx_figure_pages')}) ft")
    return f"""select *, sum(case when tag = 'figcaption' and kind = 'open' then 1 else 0 end) over (partition by doc_id, figure order by pos rows between unbounded preceding and current row) n_captions from (
      select *, {last('figure', 'open')} figure, {last('figure', 'close')} figure_end, {last('figcaption', 'open')} caption, {last('figcaption', 'close')} caption_end from ({tokens}) t) u where figure > coalesce(figure_end, -1)"""


@operator
def figure_pairing(d: Spark) -> str:
    """A figure is the pictures inside it and its first caption; loose text in it joins the caption. A caption without a picture is text."""
    in_caption = "caption > figure and caption > coalesce(caption_end, -1)"
    text = lambda when: squeeze(d, d.join(decoded("tok"), "", "pos", f"kind = 'text' and {when}"))
    return f"""select doc_id, figure, n_img, trim(coalesce(caption, '') || ' ' || coalesce(loose, '')) caption, case when n_img = 0 then 'text' else 'figure' end kind from (
      select doc_id, row_number() over (partition by doc_id order by figure) figure, n_img, caption, loose from (
        select doc_id, figure, count_if(tag = 'img') n_img, {text(f'in_caption and n_captions = 1')} caption, {text('not in_caption')} loose from (select *, coalesce({in_caption}, false) in_caption from figure_tokens) f group by doc_id, figure) g) h"""


@operator
def code_block_lines(d: Spark) -> str:
    """The lines of each pre of a page: a break is a line's end; the first newline and trailing ones are no part of it."""
    from .html import tokens_of

    body = d.join(f"case when tag = 'br' then {d.text(chr(10))} when kind = 'text' then {decoded('tok')} else '' end", "", "pos")
    opened = "max(case when tag = 'pre' and kind = '{0}' then pos end) over (partition by doc_id order by pos rows between unbounded preceding and current row)"
    blocks = f"""select doc_id, cast(row_number() over (partition by doc_id order by block) as bigint) block, {d.sub(body, r'^\n|\n+$')} code from (
      select *, {opened.format('open')} block, {opened.format('close')} ended from ({tokens_of(d, 'fx_code_pages')}) t) u where block > coalesce(ended, -1) group by doc_id, block"""
    return f"select doc_id, block, cast(pos as bigint) line_no, x line from ({d.each(f'({blocks}) cb', d.split('code', chr(10)), 'doc_id, block')}) l"


# Corpus as text and as markdown: one string a page, from its blocks in order.


@view
def clean_runs(d: Spark) -> str:
    """The tokens of the cleaned pages with the number of block boundaries so far, and the address and description that an element has."""
    from .html import BLOCKS, CONTAINERS, attributes_of

    atts = f"""(select doc_id a_doc, pos a_pos, min(case when name = 'href' then value end) href, min(case when name = 'alt' then value end) alt, max(case when name = 'data-needs-alt' then 1 else 0 end) needs
      from ({attributes_of(d, 'clean_tokens')}) x group by doc_id, pos)"""
    return f"""select t.*, a.href, a.alt, a.needs, sum(case when t.tag in ({words(BLOCKS + ' ' + CONTAINERS)}) then 1 else 0 end) over (partition by t.doc_id order by t.pos rows between unbounded preceding and current row) run
      from clean_tokens t left join {atts} a on a.a_doc = t.doc_id and a.a_pos = t.pos"""


@view
def block_tokens(d: Spark) -> str:
    """The tokens of runs with the depth of lists and tables that they stand in, the table, row and cell by the place of its opening,
    and the address of the link that was opened last."""
    opened = lambda tags: f"max(case when tag in ({words(tags)}) and kind = 'open' then pos end) over w"
    depth = lambda tags: f"sum(case when tag in ({words(tags)}) and kind = 'open' then 1 when tag in ({words(tags)}) and kind = 'close' then -1 else 0 end) over w"
    return f"""select *, {depth('ul ol')} depth, {depth('table')} table_depth, {depth('blockquote')} quoted, sum(case when tag in ('ul', 'ol') and kind = 'open' then 1 else 0 end) over w list_no,
        max_by(case when tag = 'ol' then 1 else 0 end, case when tag in ('ul', 'ol') and kind = 'open' then pos end) over w ordered, max_by(coalesce(href, ''), case when tag = 'a' and kind = 'open' then pos end) over w link,
        {opened('table')} tbl, {opened('tr')} r, {opened('td th')} c, max(case when tag in ('td', 'th', 'tr', 'table') and kind = 'close' then pos end) over w cell_end,
        {opened('caption')} caption, max(case when tag = 'caption' and kind = 'close' then pos end) over w caption_end
      from clean_runs window w as (partition by doc_id order by pos rows between unbounded preceding and current row)"""


def _picture(d: Spark) -> str:
    """What stands for a picture: its description, or that it has none; nothing for a decorative one."""
    return f"case when trim(coalesce(alt, '')) <> '' then ' Picture: ' || {squeeze(d, 'alt')} || ' ' when needs = 1 then ' Picture with no description. ' else '' end"


def _said(d: Spark) -> str:
    return f"case when kind = 'text' then {decoded('tok')} when tag = 'img' then {_picture(d)} when tag = 'br' then ' ' else '' end"


def _marked(d: Spark) -> str:
    """A token in markdown: emphasis, code and links around escaped text."""
    return f"""case when kind = 'text' then {escaped(d, decoded('tok'))} when tag = 'img' then {escaped(d, _picture(d))} when tag = 'br' then ' ' when tag = 'strong' then '**' when tag = 'em' then '*' when tag = 'code' then '`'
      when tag = 'a' and kind = 'open' then '[' when tag = 'a' and kind = 'close' then '](' || coalesce(link, '') || ')' else '' end"""


def _blocks(d: Spark, where: str) -> str:
    """(doc_id, run, opener, depth, quoted, number, ordered, text, marked): blocks with the depth of their list and their number in it, as text and in markdown."""
    return f"""select doc_id, run, opener, depth, quoted, text, marked, row_number() over (partition by doc_id, list_no, opener order by run) number, ordered from (
      select doc_id, run, min(case when first_row and kind = 'open' then tag end) opener, max(depth) depth, max(quoted) quoted, max(list_no) list_no, max(ordered) ordered, {squeeze(d, d.join(_said(d), '', 'pos'))} text, {squeeze(d, d.join(_marked(d), '', 'pos'))} marked from (
        select *, pos = min(pos) over (partition by doc_id, run) first_row from block_tokens where {where}) r group by doc_id, run) t where text <> ''"""


@view
def loose_blocks(d: Spark) -> str:
    """Blocks outside tables."""
    return _blocks(d, "table_depth <= 0")


def escaped(d: Spark, s: str) -> str:
    """Text with the marks of markdown escaped."""
    marks = r"([\\`*_\[\]])"
    return d.sub(s, marks, r"\\\1") if d.name == "duck" else f"regexp_replace({s}, {d.text(marks)}, {d.text(chr(92) * 2 + '$1')})"


@view
def page_cells(d: Spark) -> str:
    """(doc_id, tbl, r, c, text): the cells of the pages' tables, each named by where it opens; empty ones too."""
    from .html import BLOCKS

    piece = f"case when kind <> 'text' and tag in ({words(BLOCKS)}) then ' ' else {_said(d)} end"
    return f"select doc_id, tbl, r, c, coalesce({squeeze(d, d.join(piece, '', 'pos'))}, '') text from block_tokens where table_depth > 0 and r > tbl and c > r and (cell_end is null or c > cell_end) group by doc_id, tbl, r, c"


@view
def page_captions(d: Spark) -> str:
    """(doc_id, run, text): the captions of the pages' tables, at the place of the table."""
    caption = squeeze(d, d.join(decoded("tok"), "", "pos", "kind = 'text'"))
    return f"""select doc_id, run, text from (select doc_id, caption, min(t_run) run, {caption} text from (select *, max(case when pos = tbl then run end) over (partition by doc_id, tbl) t_run from block_tokens) x
      where table_depth > 0 and caption > tbl and (caption_end is null or caption > caption_end) and kind = 'text' group by doc_id, caption) c where text <> ''"""


@view
def page_titles(d: Spark) -> str:
    """Titles of pages that have no level 1 heading to carry them."""
    return "select m.doc_id, m.title from page_meta m left join (select distinct doc_id from clean_tokens where tag = 'h1') h on h.doc_id = m.doc_id where h.doc_id is null and m.title <> ''"


def _tables(d: Spark, cells: str, columns: str) -> str:
    """Cells to one text a table: rows between bars, padded to the widest, a rule after the first row."""
    cell = f"replace({escaped(d, 'text')}, '|', {d.text(chr(92) + '|')})"
    blank, rule = "repeat(' | ', cast(width - cells as int))", "'| ' || repeat('--- | ', cast(width - 1 as int)) || '--- |'"
    row = f"'| ' || line || {blank} || ' |' || case when first_row then {d.text(chr(10))} || {rule} else '' end"
    return f"""select {columns}, {d.join(row, chr(10), 'r')} body from (
      select *, max(cells) over (partition by {columns}) width, r = min(r) over (partition by {columns}) first_row from (
        select {columns}, r, count(*) cells, {d.join(cell, ' | ', 'c')} line from {cells} group by {columns}, r) a) b group by {columns}"""


@operator
def table_markdown(d: Spark) -> str:
    return _tables(d, "fx_cells", "doc_id, tbl")


@operator
def corpus_to_text(d: Spark) -> str:
    """The title where no heading carries it, list items with a star or their number and two spaces a level, the cells of a row on one
    line, pictures by their description; other blocks as they are."""
    line = "case when opener = 'li' then repeat('  ', cast(greatest(depth - 1, 0) as int)) || case when ordered = 1 then cast(number as string) || '. ' else '* ' end || text else text end"
    return f"""select doc_id, {d.join('line', chr(10), 'run, part')} body from (
        select doc_id, run, 2 part, {line} line from loose_blocks
        union all select c.doc_id, s.run, 1, {d.join('c.text', '    ', 'c.c')} from page_cells c join (select doc_id, pos, run from block_tokens where tag = 'tr' and kind = 'open') s on s.doc_id = c.doc_id and s.pos = c.r group by c.doc_id, c.tbl, c.r, s.run
        union all select doc_id, run, 0, text from page_captions
        union all select doc_id, -1, 0, title || chr(10) from page_titles) m group by doc_id"""


@operator
def corpus_to_markdown(d: Spark) -> str:
    """The title where no heading carries it, headings with number signs, items with four spaces a level, emphasis, code and links, tables
    between bars below their caption, pictures by their description; marks in text escaped."""
    line = """case when opener in ('h1', 'h2', 'h3', 'h4', 'h5', 'h6') then repeat('#', cast(substr(opener, 2, 1) as int)) || ' ' || marked
      when opener = 'li' then repeat('    ', cast(greatest(depth - 1, 0) as int)) || case when ordered = 1 then cast(number as string) || '. ' else '- ' end || marked when quoted > 0 then '> ' || marked else marked end"""
    return f"""select doc_id, {d.join('line', chr(10) + chr(10), 'run, part')} body from (
        select doc_id, run, 2 part, {line} line from loose_blocks
        union all select t.doc_id, s.run, 1, t.body from ({_tables(d, 'page_cells', 'doc_id, tbl')}) t join (select doc_id, tbl, min(run) run from block_tokens where pos = tbl group by doc_id, tbl) s on s.doc_id = t.doc_id and s.tbl = t.tbl
        union all select doc_id, run, 0, {escaped(d, 'text')} from page_captions
        union all select doc_id, -1, 0, '# ' || {escaped(d, 'title')} from page_titles) m group by doc_id"""


# Extensions and what they stand for.
EXTENSIONS = {"html": "html", "htm": "html", "pdf": "pdf", "docx": "docx", "txt": "text", "md": "text", "rtf": "rtf"}
# End of fixed values.


@view
def fx_files(d: Spark) -> str:
    """Pages as files under several names, some with the first bytes of other kinds."""
    return """select 'page-' || cast(page_id as string) || case page_id % 5 when 0 then '.html' when 1 then '.pdf' when 2 then '' when 3 then '.DOCX' else '.rtf' end path, cast(length(head) as bigint) length, head from (
      select page_id, case page_id % 7 when 0 then '%PDF-1.7' || substr(html, 1, 100) when 1 then 'PK' || chr(3) || chr(4) || substr(html, 1, 100) when 2 then '' when 3 then repeat('x', 40) || '%PDF-' || substr(html, 1, 50) when 4 then '   ' || lower(substr(html, 1, 300)) else substr(html, 200, 300) end head
      from pages) h"""


@operator
def corpus_kind(d: Spark) -> str:
    """A file's kind by its extension, else by its first bytes; rich text is refused."""
    ext = f"lower({d.extract('path', r'\.([A-Za-z0-9]+)$', 1)})"
    by_name = f"case {ext} " + " ".join(f"when '{a}' then '{b}'" for a, b in EXTENSIONS.items()) + " end"
    by_bytes = f"case when {d.like('lower(head)', r'^[ \t\r\n]*<(!doctype html|html)')} then 'html' when head like '%PDF-%' and substr(head, 1, 5) = '%PDF-' then 'pdf' when substr(head, 1, 4) = 'PK' || chr(3) || chr(4) then 'docx' else 'text' end"
    return f"select path, length, coalesce({by_name}, {by_bytes}) kind, coalesce({by_name} = 'rtf', false) refused from fx_files"


@operator
def corpus_sniff(d: Spark) -> str:
    """Whether what is called a PDF is one, and how much stands before its header."""
    at = "instr(head, '%PDF-')"
    return f"""select path, case when length = 0 then 'empty' when {at} = 1 then 'pdf' when {at} > 1 and {at} <= 1024 then 'junk before' when {d.like('lower(head)', r'^[ \t\r\n]*<(!doctype html|html)')} then 'html' else 'not pdf' end verdict,
      cast(case when {at} > 1 then {at} - 1 else 0 end as bigint) junk_bytes from fx_files where {d.like('path', r'(?i)\.pdf$')}"""
