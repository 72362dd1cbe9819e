"""Plans for repair, settings that fall back, word-processor structure, and versions that arrive."""

from __future__ import annotations

from marginalia.functions.dialect import SPARK, Spark

from .base import is_lang, operator, reads, squeeze, view, words
from .layout import guesses_of
from .trees import let


@view
def big_lines(d: Spark) -> str:
    """The largest readable short line of the first page, of three, that has one."""
    good = f"length(trim(text)) between 3 and 90 and not {d.like('trim(text)', '[.]$')} and {reads(d, 'text')}"
    return f"""select doc_id, {squeeze(d, 'title')} title from (select doc_id, page, max_by(trim(text), {d.struct(size='size', first='-line')}) title, row_number() over (partition by doc_id order by page) n
      from fx_lines where {good} and page < 3 group by doc_id, page) t where n = 1"""


@operator
def title_candidates(d: Spark) -> str:
    return "select doc_id, title from big_lines"


@view
def planned_titles(d: Spark) -> str:
    """The readable title in the metadata, else the one in the dictionary, else the largest line, else the file's name."""
    readable = lambda c: f"case when {reads(d, f'trim({c})')} then trim({c}) end"
    return f"""select doc_id, coalesce(xmp, info, big, {d.sub('file_name', '[.][^.]*$')}) title,
      case when xmp is not null then 'as it is' when info is not null then 'from the dictionary' when big is not null then 'largest line' else 'file name' end reason from (
        select p.doc_id, p.file_name, {readable("coalesce(p.xmp_title, '')")} xmp, {readable("coalesce(p.info_title, '')")} info, nullif(b.title, '') big from fx_docs p left join big_lines b on b.doc_id = p.doc_id) t"""


@operator
def title_plan(d: Spark) -> str:
    return "select doc_id, title, reason from planned_titles where reason <> 'as it is'"


@view
def page_guesses(d: Spark) -> str:
    """What the first six pages are written in."""
    return guesses_of(d, f"(select doc_id, {d.join('text', ' ', 'page')} text from fx_pdf_pages where page <= 6 group by doc_id) fp")


@view
def planned_langs(d: Spark) -> str:
    """A language that a document names stays, code or not; without one it is guessed."""
    return """select p.doc_id, case when trim(coalesce(p.lang, '')) <> '' then trim(p.lang) when coalesce(g.guess, '') <> '' then g.guess else 'en-US' end lang,
      case when trim(coalesce(p.lang, '')) <> '' then 'as it is' when coalesce(g.guess, '') <> '' then 'guessed' else 'default' end reason from fx_docs p left join page_guesses g on g.doc_id = p.doc_id"""


@operator
def lang_plan(d: Spark) -> str:
    return "select doc_id, lang, reason from planned_langs where reason <> 'as it is'"


@operator
def link_text_plan(d: Spark) -> str:
    """What a link would be called: the words in its rectangle, else its address."""
    return f"""select r.doc_id, r.page, r.link_id, coalesce(w.text, r.uri) contents from fx_link_rects r left join (
        select doc_id, page, link_id, trim({d.join('text', ' ', 'word_id')}) text from words_in_links group by doc_id, page, link_id) w
      on w.doc_id = r.doc_id and w.page = r.page and w.link_id = r.link_id"""


@view
def planned_tabs(d: Spark) -> str:
    return """select p.doc_id, p.page, case when e.doc_id is not null then '/S' else '/R' end tabs from fx_pdf_pages p left join (select distinct doc_id from fx_elems) e on e.doc_id = p.doc_id
      where exists (select 1 from fx_annots a where a.doc_id = p.doc_id and a.page = p.page) and p.tabs <> case when e.doc_id is not null then '/S' else '/R' end"""


@operator
def tab_order_plan(d: Spark) -> str:
    return "select doc_id, page, tabs from planned_tabs"


@operator
def repair_plan(d: Spark) -> str:
    return """select doc_id, 'title' field, title new_value, reason from planned_titles where reason <> 'as it is'
      union all select doc_id, 'lang', lang, reason from planned_langs where reason <> 'as it is'
      union all select doc_id, 'tabs', cast(count(*) as string), 'tab order' from planned_tabs group by doc_id"""


@operator
def page_loss(d: Spark) -> str:
    return "select p.doc_id, p.found, c.expected from (select doc_id, count(*) found from fx_pdf_pages group by doc_id) p join fx_declared c on c.doc_id = p.doc_id where p.found < c.expected"


# Page sizes, the ranges of numbers, and what stands where nothing usable is given.
PAGE_SIZES, DEFAULT_PAGE = "letter A4 legal", "letter"
DEFAULT_MARGIN, LEAST_MARGIN, MOST_MARGIN = 1.0, 0.25, 3.0
DEFAULT_POINTS, LEAST_POINTS, MOST_POINTS = 11.0, 6.0, 36.0
DEFAULT_FONT, FONT = "Arial, Helvetica, sans-serif", """^[A-Za-z0-9 ,'"-]+$"""
DEFAULT_LANG = "en-US"
# End of fixed values.


@view
def used_settings(d: Spark) -> str:
    """Settings as they are used: a number out of range becomes the end of the range, what cannot be used the default."""
    def number(name: str, column: str, default: float, least: float, most: float, places: int) -> str:
        x = d.number(f"trim({column})")
        held = f"least(greatest(coalesce({x}, cast({default} as double)), cast({least} as double)), cast({most} as double))"
        text = d.sub(f"{'format_string' if d.name == 'spark' else 'printf'}('%.{places}f', {held})", "[.]?0+$")
        return f"select doc_id, '{name}' setting, {text} value, trim(coalesce({column}, '')) <> '' and ({x} is null or {x} <> {held}) fell_back from fx_meta"

    def text(name: str, value: str, usable: str, default: str) -> str:
        return f"select doc_id, '{name}' setting, case when {usable} then {value} else {d.text(default)} end value, {value} <> '' and not ({usable}) fell_back from fx_meta"

    page, font, lang = "trim(coalesce(page_size, ''))", squeeze(d, "coalesce(font_family, '')"), "trim(coalesce(lang, ''))"
    return " union all ".join((
        text("page", page, f"{page} in ({words(PAGE_SIZES)})", DEFAULT_PAGE),
        number("margin", "margin_inches", DEFAULT_MARGIN, LEAST_MARGIN, MOST_MARGIN, 3),
        number("points", "font_points", DEFAULT_POINTS, LEAST_POINTS, MOST_POINTS, 1),
        text("font", font, d.like(font, FONT), DEFAULT_FONT),
        text("lang", lang, is_lang(d, lang), DEFAULT_LANG),
    ))


@operator
def export_settings(d: Spark) -> str:
    """What is given but cannot be used as it stands has fallen back; a blank takes the default and has not."""
    return "select doc_id, setting, value, fell_back from used_settings"


@operator
def export_fallbacks(d: Spark) -> str:
    """How many documents fell back, by setting."""
    return "select setting, count(*) docs, count_if(fell_back) fell_back from used_settings group by setting"


@operator
def heading_levels_from_styles(d: Spark) -> str:
    """A paragraph's level by its own style's name or id, else by its outline level, its own or that of the nearest of twelve styles; levels from 0 to 5 count."""
    numbered = lambda c: d.extract(f"lower({c})", r"^heading\s*([1-9])$", 1)
    by_name, by_id = numbered("coalesce(s.style_name, '')"), d.extract("lower(cast(p.style_id as string))", "^heading([1-9])$", 1)
    named = f"case when lower(s.style_name) = 'title' then 1 when {by_name} <> '' then least(cast({by_name} as int), 6) when {by_id} <> '' then least(cast({by_id} as int), 6) end"
    return f"""with recursive chain as (select doc_id, style_id, base_id, outline_lvl, 0 step from fx_styles
      union all select c.doc_id, c.style_id, s.base_id, s.outline_lvl, c.step + 1 from chain c join fx_styles s on s.doc_id = c.doc_id and s.style_id = c.base_id where c.step < 11 and c.outline_lvl is null)
      select doc_id, para, cast(coalesce(named, case when outline between 0 and 5 then outline + 1 end) as int) level from (
        select p.doc_id, p.para, {named} named, coalesce(p.outline_lvl, o.outline) outline from fx_doc_paragraphs p left join fx_styles s on s.doc_id = p.doc_id and s.style_id = p.style_id
        left join (select doc_id, style_id, max(outline_lvl) outline from chain group by doc_id, style_id) o on o.doc_id = p.doc_id and o.style_id = p.style_id) l
      where named is not null or outline between 0 and 5"""


def _numbering_by_document(name: str) -> str:
    """The same with a document's styles, numbers and levels as arrays beside its paragraphs: all that is joined or gathered is so by
    document alone. A paragraph without a number follows its styles in a fold, each step to all the styles that the step before names."""
    by_doc = lambda source, where="true", **fields: f"(select doc_id, collect_list({SPARK.struct(**fields)}) a from {source} where {where} group by doc_id)"
    largest = lambda c: f"greatest(w.{c}, array_max(transform(f, n -> n.{c})))"
    further = "array_distinct(transform(filter(f, n -> n.more and n.base is not null), n -> n.base))"
    step = let("f", "filter(nodes, n -> array_contains(w.ids, n.id))", SPARK.struct(ids=further, num=largest("num"), lvl=largest("lvl")))
    none = lambda c: f"get(transform(filter(nodes, n -> false), n -> n.{c}), 0)"
    walk = f"aggregate(sequence(1, 12), {SPARK.struct(ids='array(style)', num=none('num'), lvl=none('lvl'))}, (w, i) -> if(size(w.ids) = 0, w, {step}))"
    most = lambda c: f"array_max(transform(filter(m, x -> x.num is not null), x -> x.{c}))"
    more = "not coalesce(exists(m, x -> x.num is not null), false) or coalesce(exists(m, x -> x.num is null), false)"
    node = let("m", "filter(own, x -> x.id = s.id)", SPARK.struct(id="s.id", base="s.base", more=more, num=most("num"), lvl=most("lvl")))
    fmt = "array_min(transform(filter(overrides, x -> x.num = n.num and x.lvl = level), x -> named_struct('seq', x.seq, 'fmt', x.fmt))).fmt"
    return f"""select doc_id, para, case when fmt is not null then case when fmt = 'bullet' then 'ul' else 'ol' end when n is null then 'ul' when l is null or coalesce(l.fmt, 'decimal') in ('bullet', 'none') then 'ul' else 'ol' end tag, cast(level as int) level
      from (select doc_id, para, level, n, fmt, explode_outer(filter(levels, x -> x.id = n.abs and x.lvl = level)) l
      from (select doc_id, para, level, n, levels, {fmt} fmt
      from (select doc_id, para, level, overrides, levels, explode_outer(filter(nums, x -> x.num = num_id)) n
      from (select doc_id, para, num_id, nums, overrides, levels, case when given is not null then coalesce(ilvl, 0) when followed is not null then followed when {name} <> '' then cast({name} as int) - 1 else 0 end level
      from (select doc_id, para, given, num_id, followed, ilvl, nums, overrides, levels, explode_outer(transform(filter(styles, s -> s.id = style), s -> s.name)) style_name
      from (select *, coalesce(given, c.num) num_id, c.lvl followed from (select *, case when given is null then {walk} end c
      from (select *, case when given is null then transform(styles, s -> {node}) end nodes from (
        select p.doc_id, p.para, cast(p.style_id as string) style, p.num_id given, p.ilvl, s.a styles, o.a own, n.a nums, v.a overrides, l.a levels from fx_doc_paragraphs p
        left join {by_doc('fx_styles', id='cast(style_id as string)', base='cast(base_id as string)', name='style_name')} s on s.doc_id = p.doc_id
        left join {by_doc('fx_style_nums', id='cast(style_id as string)', num='num_id', lvl='ilvl')} o on o.doc_id = p.doc_id
        left join {by_doc('fx_nums', num='num_id', abs='abstract_id')} n on n.doc_id = p.doc_id
        left join {by_doc('fx_num_overrides', 'fmt is not null and seq is not null', num='num_id', lvl='ilvl', seq='seq', fmt='fmt')} v on v.doc_id = p.doc_id
        left join {by_doc('fx_abstract_nums', id='abstract_id', lvl='ilvl', fmt='fmt')} l on l.doc_id = p.doc_id) j) k) w) y where num_id > 0) z) q) r) u) t"""


@operator
def numbering_kind(d: Spark) -> str:
    """Bulleted or numbered, and the level. A paragraph's own number counts, else that of the nearest of twelve styles that has one; a
    style without a level of its own takes it from the paragraph's style name. A document's number is bulleted by its override of that
    level where this names a format, else by its abstract level (numbered where that names none), and where neither is known. Of
    overrides that repeat a level, the first by ``seq`` that names a format counts."""
    name = d.extract("lower(coalesce(style_name, ''))", r"^list (?:bullet|number) ([2-9])$", 1)
    if d.name == "spark":
        return _numbering_by_document(name)
    return f"""with recursive numbered_styles as (select s.doc_id, s.style_id, s.base_id, s.style_name, n.num_id, n.ilvl from fx_styles s left join fx_style_nums n on n.doc_id = s.doc_id and n.style_id = s.style_id),
      num_chain as (select doc_id, style_id, base_id, num_id, ilvl, 0 step from numbered_styles
        union all select c.doc_id, c.style_id, s.base_id, s.num_id, s.ilvl, c.step + 1 from num_chain c join numbered_styles s on s.doc_id = c.doc_id and s.style_id = c.base_id where c.step < 11 and c.num_id is null),
      paras as (select p.doc_id, p.para, coalesce(p.num_id, c.num_id) num_id, case when p.num_id is not null then coalesce(p.ilvl, 0) when c.ilvl is not null then c.ilvl when {name} <> '' then cast({name} as int) - 1 else 0 end level
        from fx_doc_paragraphs p left join (select doc_id, style_id, max(num_id) num_id, max(ilvl) ilvl from num_chain where num_id is not null group by doc_id, style_id) c on c.doc_id = p.doc_id and c.style_id = p.style_id
        left join fx_styles s on s.doc_id = p.doc_id and s.style_id = p.style_id)
      select p.doc_id, p.para, case when o.fmt is not null then case when o.fmt = 'bullet' then 'ul' else 'ol' end when n.num_id is null then 'ul' when a.abstract_id is null or coalesce(a.fmt, 'decimal') in ('bullet', 'none') then 'ul' else 'ol' end tag, cast(p.level as int) level
      from paras p left join fx_nums n on n.doc_id = p.doc_id and n.num_id = p.num_id
      left join (select doc_id, num_id, ilvl, min_by(fmt, seq) fmt from fx_num_overrides where fmt is not null group by doc_id, num_id, ilvl) o on o.doc_id = n.doc_id and o.num_id = n.num_id and o.ilvl = p.level
      left join fx_abstract_nums a on a.doc_id = n.doc_id and a.abstract_id = n.abstract_id and a.ilvl = p.level where p.num_id > 0"""


@operator
def unread_content(d: Spark) -> str:
    return " union all ".join(f"select doc_id, '{c}' feature from fx_doc_features where {c}" for c in "tracked textboxes equations toc notes comments headers".split())


@operator
def nested_lists(d: Spark) -> str:
    """Items in order to lists: a deeper item opens a list inside the one before, another tag on a level opens a new list beside.
    A list is named by its first item; an item's parent is the item that holds its list."""
    if d.name == "duck":
        return """with before as (select i.doc_id, i.item_id, i.level, i.tag, max(case when b.level < i.level then b.item_id end) parent_id, max(case when b.level = i.level then b.item_id end) same_id
            from fx_list_items i left join fx_list_items b on b.doc_id = i.doc_id and b.item_id < i.item_id group by i.doc_id, i.item_id, i.level, i.tag),
          starts as (select b.*, not (coalesce(b.same_id, -1) > coalesce(b.parent_id, -1) and coalesce(s.tag = b.tag, false)) opens from before b left join fx_list_items s on s.doc_id = b.doc_id and s.item_id = b.same_id)
          select doc_id, item_id, parent_id, max(case when opens then item_id end) over (partition by doc_id, level order by item_id rows between unbounded preceding and current row) list_id from starts"""
    entry = "struct<level:int,tag:string,list:int,item:int>"
    step = "transform(array(filter(a.open, s -> s.level < i.level)), up -> transform(array(coalesce(get(filter(a.open, s -> s.level = i.level and s.tag = i.tag), 0).list, i.item_id)), id -> named_struct('open', array_append(up, named_struct('level', i.level, 'tag', i.tag, 'list', id, 'item', i.item_id)), 'out', array_append(a.out, named_struct('item_id', i.item_id, 'list_id', id, 'parent_id', try_element_at(up, -1).item))))[0])[0]"
    fold = f"aggregate(items, named_struct('open', cast(array() as array<{entry}>), 'out', cast(array() as array<struct<item_id:int,list_id:int,parent_id:int>>)), (a, i) -> {step})"
    return f"""select doc_id, o.item_id item_id, o.parent_id parent_id, o.list_id list_id from (select doc_id, explode({fold}.out) o from (
      select doc_id, array_sort(collect_list(named_struct('item_id', cast(item_id as int), 'level', cast(level as int), 'tag', tag))) items from fx_list_items group by doc_id) g) e"""


@operator
def latest_snapshot(d: Spark) -> str:
    """The newest snapshot of every source."""
    return f"""select source_id, s.snapshot_id, s.title from (select source_id, max_by({d.struct(snapshot_id='snapshot_id', title='title')}, {d.struct(at='saved_at', id='snapshot_id')}) s from fx_snapshots group by source_id) t"""


@operator
def recent_sources(d: Spark) -> str:
    """The last eight distinct items of each user."""
    return """select user_id, n recency, event_type item from (select user_id, event_type, row_number() over (partition by user_id order by max(ts) desc, event_type) n from events group by user_id, event_type) t where n <= 8"""
