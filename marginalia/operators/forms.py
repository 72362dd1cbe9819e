"""Blanks on flat forms: where they are, what they are called, and how answers fit the fields. Boxes meet on (document, page)."""

from __future__ import annotations

import re

from marginalia.functions.dialect import Spark

from .base import banded, meet, operator, squeeze, stored, view, words
from .trees import let


def overlaps(a: str, b: str) -> str:
    """Whether two boxes have over 0.45 of the smaller one in common."""
    w = f"(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))"
    h = f"(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"
    area = lambda t: f"({t}.x1 - {t}.x0) * ({t}.y1 - {t}.y0)"
    return f"{w} > 0 and {h} > 0 and {w} * {h} > 0.45 * least({area(a)}, {area(b)})"


def same_row(a: str, b: str) -> str:
    return f"least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0) > 0.4 * least({a}.y1 - {a}.y0, {b}.y1 - {b}.y0)"


def label(d: Spark, s: str) -> str:
    """A label without marks, numbers and trailing signs, 60 characters at most; empty without a letter or digit."""
    clean = d.sub(d.sub(squeeze(d, s), r"^[•·*-]+ *|^[0-9]+[.)] *"), r"[:._ -]+$")
    return f"case when {d.like(clean, r'[\p{L}\p{N}]')} then substr({clean}, 1, 60) else '' end"


@view
def fx_chars(d: Spark) -> str:
    """Every character of the lines, four points wide."""
    chars = d.each("fx_form_lines", d.extract_all("text", "(?s).", 0), "doc_id, page, line, x0, y0, y1")
    return f"select doc_id, page, line, cast(pos as int) idx, x ch, x0 + 4 * pos x0, y0, x0 + 4 * pos + 4 x1, y1 from ({chars}) c"


@view
def blank_runs(d: Spark) -> str:
    """Runs of three or more underscores of a line, with the box of the run."""
    return """select doc_id, page, line, grp, min(x0) x0, min(y0) y0, max(x1) x1, max(y1) y1, min(idx) first_idx from (
      select *, idx - row_number() over (partition by doc_id, page, line order by idx) grp from fx_chars where ch = '_') c group by doc_id, page, line, grp having count(*) >= 3 and max(x1) - min(x0) >= 20"""


@operator
def blanks_underscores(d: Spark) -> str:
    return f"""select r.doc_id, r.page, r.line, cast(r.x0 as double) x0, cast(r.x1 as double) x1, {label(d, "substr(l.text, 1, cast(r.first_idx as int))")} label, case when {label(d, "substr(l.text, 1, cast(r.first_idx as int))")} = '' then 0.7 else 0.9 end confidence
      from blank_runs r join fx_form_lines l on l.doc_id = r.doc_id and l.page = r.page and l.line = r.line""".replace("0.7 else 0.9 end", "cast(0.7 as double) else cast(0.9 as double) end")


@operator
def blanks_brackets(d: Spark) -> str:
    """Check boxes drawn as brackets."""
    return f"""select doc_id, page, line, {label(d, d.sub('text', r'^.*[\[(] {0,4}[\])]'))} label from fx_form_lines where {d.like('text', r'[\[(] {0,4}[\])]')}"""


@view
def rules(d: Spark) -> str:
    return "select * from fx_shapes where kind = 'rule' and x1 - x0 >= 40"


@view
def left_labels(d: Spark) -> str:
    """For each shape, the nearest line on its row that ends within 60 points left of it."""
    shapes = "(select doc_id, page, shape_id, kind, x0, x1, y0 - case when kind = 'rule' then 12 else 0 end y0, y1 from fx_shapes) r"
    return f"""select s.doc_id, s.page, s.shape_id, max_by(l.text, {d.struct(x='l.x1', line='l.line')}) text from {banded(d, shapes, 'y0', 'y1')} s
      join {banded(d, 'fx_form_lines', 'y0', 'y1')} l on l.doc_id = s.doc_id and l.page = s.page and {meet(d, 'l', 's')} and {same_row('l', 's')} and l.x1 <= s.x0 + 2 and s.x0 - l.x1 <= 60 group by s.doc_id, s.page, s.shape_id"""


@view
def right_labels(d: Spark) -> str:
    """For each box to tick, the nearest line on its row that begins within 60 points right of it."""
    return f"""select s.doc_id, s.page, s.shape_id, min_by(l.text, {d.struct(x='l.x0', line='l.line')}) text from {banded(d, 'fx_tick_shapes', 'y0', 'y1')} s
      join {banded(d, 'fx_form_lines', 'y0', 'y1')} l on l.doc_id = s.doc_id and l.page = s.page and {meet(d, 'l', 's')} and {same_row('l', 's')} and l.x0 >= s.x1 - 2 and l.x0 - s.x1 <= 60 group by s.doc_id, s.page, s.shape_id"""


@view
def above_labels(d: Spark) -> str:
    """The lowest line whose bottom is from 2 points under to 26 over the shape, and that overlaps a quarter of its width."""
    return f"""select s.doc_id, s.page, s.shape_id, max_by(l.text, {d.struct(y='l.y1', line='l.line')}) text from {banded(d, 'fx_shapes', 'y0 - 26', 'y0 + 2')} s
      join {banded(d, 'fx_form_lines', 'y1', 'y1')} l on l.doc_id = s.doc_id and l.page = s.page and {meet(d, 'l', 's')} and s.y0 - l.y1 between -2 and 26 and least(l.x1, s.x1) - greatest(l.x0, s.x0) >= 0.25 * (s.x1 - s.x0) and s.x1 > s.x0 group by s.doc_id, s.page, s.shape_id"""


@operator
def label_left(d: Spark) -> str:
    return f"select doc_id, page, shape_id, {label(d, 'text')} label from left_labels"


@operator
def label_right(d: Spark) -> str:
    """The first four words."""
    return f"select doc_id, page, shape_id, {d.extract(label(d, 'text'), '^([^ ]+( [^ ]+){0,3})', 1)} label from right_labels"


@operator
def label_above(d: Spark) -> str:
    return f"select doc_id, page, shape_id, {label(d, 'text')} label from above_labels"


@view
def rule_blanks(d: Spark) -> str:
    """Rules to write on, by where their label stands."""
    return f"""select r.doc_id, r.page, r.shape_id, coalesce(l.text, a.text, '') text, case when {d.like("coalesce(l.text, '')", ':[ _]*$')} then cast(0.8 as double) when l.text is not null or a.text is not null then cast(0.62 as double) else cast(0.35 as double) end confidence,
        l.text is null and a.text is not null and r.x1 - r.x0 >= 0.65 * w.width too_wide, r.x1 - r.x0 >= 0.88 * g.width bare_wide, l.text is null and a.text is null bare
      from rules r join (select doc_id, page, max(x1) - min(x0) width from fx_form_lines group by doc_id, page) w on w.doc_id = r.doc_id and w.page = r.page
      join fx_form_pages g on g.doc_id = r.doc_id and g.page = r.page left join left_labels l on l.doc_id = r.doc_id and l.page = r.page and l.shape_id = r.shape_id left join above_labels a on a.doc_id = r.doc_id and a.page = r.page and a.shape_id = r.shape_id"""


@operator
def blanks_rules(d: Spark) -> str:
    return f"select doc_id, page, shape_id, {label(d, 'text')} label, confidence from rule_blanks where not too_wide and not (bare and bare_wide)"


@operator
def blanks_boxes(d: Spark) -> str:
    """Empty boxes: small square ones to tick, larger ones to write in."""
    return f"""select s.doc_id, s.page, s.shape_id, case when s.x1 - s.x0 between 6 and 22 and s.y1 - s.y0 between 6 and 22 and (s.x1 - s.x0) / (s.y1 - s.y0) between 0.55 and 1.8 then 'checkbox'
          when s.y1 - s.y0 > 2.2 * 12 then 'multiline text' else 'text' end kind, l.text is not null or a.text is not null labelled
      from fx_shapes s left join left_labels l on l.doc_id = s.doc_id and l.page = s.page and l.shape_id = s.shape_id left join above_labels a on a.doc_id = s.doc_id and a.page = s.page and a.shape_id = s.shape_id
      where s.kind = 'box' and ((s.x1 - s.x0 between 6 and 22 and s.y1 - s.y0 between 6 and 22) or (s.x1 - s.x0 >= 20 and s.y1 - s.y0 >= 8))
        and not exists (select 1 from fx_form_lines t where t.doc_id = s.doc_id and t.page = s.page and (t.x0 + t.x1) / 2 > s.x0 and (t.x0 + t.x1) / 2 < s.x1 and (t.y0 + t.y1) / 2 > s.y0 and (t.y0 + t.y1) / 2 < s.y1)"""


@operator
def blanks_colons(d: Spark) -> str:
    """Lines that end in a colon with room to the right and nothing else on their row."""
    return f"""select l.doc_id, l.page, l.line, {label(d, 'l.text')} label from fx_form_lines l join (select doc_id, page, max(x1) edge from fx_form_lines group by doc_id, page) e on e.doc_id = l.doc_id and e.page = l.page
      where {d.like('l.text', r'\p{L}.*: *$')} and greatest(e.edge, 540) - l.x1 >= 60 and not exists (select 1 from fx_form_lines o where o.doc_id = l.doc_id and o.page = l.page and o.line <> l.line and o.x0 >= l.x1 and {same_row('o', 'l')})"""


@view
def grid_bands(d: Spark) -> str:
    """Neighbouring rules 8 to 120 points apart that overlap by 40."""
    return """select * from (select doc_id, page, shape_id, x0, x1, y1 top, lead(shape_id) over w next_id, lead(x0) over w nx0, lead(x1) over w nx1, lead(y0) over w bottom from rules
      window w as (partition by doc_id, page order by y0, shape_id)) r where bottom - top between 8 and 120 and least(x1, nx1) - greatest(x0, nx0) >= 40"""


@view
def grid_cells(d: Spark) -> str:
    """Between two neighbouring uprights that cross both rules of a band within 2 points."""
    return """select *, min(cx0) over (partition by doc_id, page, shape_id) first_x from (
      select b.doc_id, b.page, b.shape_id, b.next_id, b.top, b.bottom, u.shape_id upright, u.x0 cx0, lead(u.x0) over (partition by b.doc_id, b.page, b.shape_id order by u.x0, u.shape_id) cx1 from grid_bands b
      join fx_shapes u on u.doc_id = b.doc_id and u.page = b.page and u.kind = 'upright' and u.y0 <= b.top + 2 and u.y1 >= b.bottom - 2 and u.x0 between greatest(b.x0, 0) - 2 and b.x1 + 200) c where cx1 - cx0 >= 20"""


@operator
def blanks_grid(d: Spark) -> str:
    """Empty cells of a lattice."""
    return """select c.doc_id, c.page, c.shape_id, c.upright, cast(c.cx0 as double) x0, cast(c.cx1 as double) x1 from grid_cells c where not exists (
      select 1 from fx_form_lines t where t.doc_id = c.doc_id and t.page = c.page and (t.x0 + t.x1) / 2 between c.cx0 and c.cx1 and (t.y0 + t.y1) / 2 between c.top and c.bottom)"""


@operator
def label_headings(d: Spark) -> str:
    """A cell's heading: the topmost line centred in its column, above its row and within the lattice; without one, the leftmost line of its row before the column."""
    column = f"""select c.doc_id, c.page, c.shape_id, c.upright, min_by(t.text, {d.struct(y='t.y0', line='t.line')}) text from grid_cells c
      join (select doc_id, page, min(y0) lattice_top from fx_shapes where kind = 'upright' group by doc_id, page) u on u.doc_id = c.doc_id and u.page = c.page
      join fx_form_lines t on t.doc_id = c.doc_id and t.page = c.page and (t.x0 + t.x1) / 2 between c.cx0 and c.cx1 and t.y1 <= c.top + 2 and t.y0 >= u.lattice_top - 2 group by c.doc_id, c.page, c.shape_id, c.upright"""
    row = f"""select c.doc_id, c.page, c.shape_id, c.upright, min_by(t.text, {d.struct(x='t.x0', line='t.line')}) text from grid_cells c
      join fx_form_lines t on t.doc_id = c.doc_id and t.page = c.page and (t.y0 + t.y1) / 2 between c.top and c.bottom and t.x0 >= c.first_x - 2 and t.x1 <= c.cx0 + 2
      where c.cx0 - c.first_x >= 1 group by c.doc_id, c.page, c.shape_id, c.upright"""
    return f"""select c.doc_id, c.page, c.shape_id, c.upright, coalesce(nullif({label(d, "coalesce(h.text, '')")}, ''), {label(d, "coalesce(r.text, '')")}) label from grid_cells c
      left join ({column}) h on h.doc_id = c.doc_id and h.page = c.page and h.shape_id = c.shape_id and h.upright = c.upright
      left join ({row}) r on r.doc_id = c.doc_id and r.page = c.page and r.shape_id = c.shape_id and r.upright = c.upright"""


@operator
def label_inline(d: Spark) -> str:
    """What stands before and after a run of underscores in its line."""
    return f"""select doc_id, page, line, {label(d, d.extract('text', '^([^_]*)_{3,}', 1))} before, {label(d, d.extract('text', '_{3,}([^_]*)$', 1))} after from fx_form_lines where {d.like('text', '_{3,}')}"""


@operator
def proposal_dedupe(d: Spark) -> str:
    """Surest first, then from the top: a proposal goes where it overlaps one that stays by over 0.45 of the smaller, and lends
    its label to the first such one if that has none. A colon guess goes where a surer one that stays carries its label."""
    area = lambda t: f"({t}.x1 - {t}.x0) * ({t}.y1 - {t}.y0)"
    met = lambda k, p: f"greatest(0, least({k}.x1, {p}.x1) - greatest({k}.x0, {p}.x0)) * greatest(0, least({k}.y1, {p}.y1) - greatest({k}.y0, {p}.y0)) > 0.45 * least({area(k)}, {area(p)})"
    if d.name == "spark":
        kind = "struct<c:double,y0:double,x0:double,pid:int,x1:double,y1:double,label:string,source:string>"
        lent = "named_struct('c', k.c, 'y0', k.y0, 'x0', k.x0, 'pid', k.pid, 'x1', k.x1, 'y1', k.y1, 'label', p.label, 'source', k.source)"
        fold = f"""aggregate(ps, cast(array() as array<{kind}>), (kept, p) -> transform(array(array_position(transform(kept, k -> {met('k', 'p')}), true)),
            at -> if(at = 0, concat(kept, array(p)), transform(kept, (k, i) -> if(i = at - 1 and k.label = '', {lent}, k))))[0])"""
        solid = "transform(filter(kept, k -> k.source <> 'colon' and k.label <> ''), k -> k.label)"
        return f"""select doc_id, page, k.pid pid, k.label label from (select doc_id, page, kept, {solid} solid from (select doc_id, page, {fold} kept from (
          select doc_id, page, array_sort(collect_list(named_struct('c', -cast(confidence as double), 'y0', cast(y0 as double), 'x0', cast(x0 as double), 'pid', cast(pid as int), 'x1', cast(x1 as double), 'y1', cast(y1 as double),
            'label', coalesce(label, ''), 'source', coalesce(source, '')))) ps from fx_proposals group by doc_id, page) g) a) b lateral view explode(kept) e as k where k.source <> 'colon' or not array_contains(solid, k.label)"""
    at = f"coalesce(list_position(list_transform(k.kept, lambda q: {met('q', 'o')}), true), 0)"
    own = "{'pid': o.pid, 'x0': o.x0, 'x1': o.x1, 'y0': o.y0, 'y1': o.y1, 'label': o.label, 'source': o.source}"
    return f"""with recursive o as (select doc_id, page, cast(pid as int) pid, cast(x0 as double) x0, cast(x1 as double) x1, cast(y0 as double) y0, cast(y1 as double) y1, coalesce(label, '') as label, coalesce(source, '') source,
        row_number() over (partition by doc_id, page order by -cast(confidence as double), y0, x0, pid) i from fx_proposals),
      k as (select doc_id, page, i, [{own.replace('o.', '')}] kept from o where i = 1
        union all select o.doc_id, o.page, o.i, case when {at} = 0 then list_append(k.kept, {own}) when k.kept[{at}].label = '' then
          list_concat(list_concat(k.kept[1:{at} - 1], [struct_pack(pid := k.kept[{at}].pid, x0 := k.kept[{at}].x0, x1 := k.kept[{at}].x1, y0 := k.kept[{at}].y0, y1 := k.kept[{at}].y1, "label" := o.label, source := k.kept[{at}].source)]), k.kept[{at} + 1:])
          else k.kept end from o join k on k.doc_id = o.doc_id and k.page = o.page and o.i = k.i + 1),
      f as (select doc_id, page, unnest(kept) x from (select doc_id, page, max_by(kept, i) kept from k group by doc_id, page) t)
      select doc_id, page, x.pid pid, x.label as label from f where x.source <> 'colon' or not exists (select 1 from f s where s.doc_id = f.doc_id and s.page = f.page and s.x.source <> 'colon' and s.x.label <> '' and s.x.label = f.x.label)"""


@operator
def proposal_existing(d: Spark) -> str:
    """Proposals that overlap no field by over 0.45."""
    return f"""select p.doc_id, p.page, p.pid from fx_proposals p left join (select p.doc_id, p.pid from {banded(d, 'fx_proposals', 'y0', 'y1')} p join {banded(d, 'fx_fields', 'y0', 'y1')} f on f.doc_id = p.doc_id and f.page = p.page and {meet(d, 'p', 'f')} and {overlaps('p', 'f')} group by p.doc_id, p.pid) o
      on o.doc_id = p.doc_id and o.pid = p.pid where o.pid is null"""


@operator
def unlabelled_names(d: Spark) -> str:
    return """select doc_id, page, pid, case when label <> '' then label else 'Blank ' || cast(sum(case when label = '' then 1 else 0 end) over (partition by doc_id, page order by pid rows between unbounded preceding and current row) as string) || ' on page ' || cast(page as string) end label from fx_proposals"""


@operator
def unique_names(d: Spark) -> str:
    """Labels as names, none twice in a document: in order, a name that is taken gets the least number from 2 on that makes it new."""
    tidy = d.sub(d.sub("lower(coalesce(label, ''))", "[^a-z0-9]+", "_"), "^_+|_+$")
    slug = f"coalesce(nullif({d.sub(f'substr({tidy}, 1, 40)', '_+$')}, ''), 'field')"
    if d.name == "duck":
        name = "case when list_contains(u.used, s.slug) then s.slug || '_' || cast(list_filter(range(2, len(u.used) + 3), lambda n: not list_contains(u.used, s.slug || '_' || cast(n as varchar)))[1] as varchar) else s.slug end"
        return f"""with recursive s as (select doc_id, pid, slug, row_number() over (partition by doc_id order by page, pid) i from (select doc_id, page, pid, {slug} slug from fx_proposals) a),
          u as (select doc_id, pid, i, slug as name, [slug] used from s where i = 1
            union all select s.doc_id, s.pid, s.i, {name}, list_append(u.used, {name}) from s join u on u.doc_id = s.doc_id and s.i = u.i + 1)
          select doc_id, pid, name from u"""
    # the k-th of a name needs a number of k at least, and one more for each name of the document that has such a form itself
    free = "filter(sequence(greatest(2, p.k), greatest(2, p.k) + 2 * numbered + 1), n -> not array_contains(u.used, concat(p.slug, '_', n)))[0]"
    fold = f"""aggregate(ps, named_struct('used', cast(array() as array<string>), 'out', cast(array() as array<struct<pid:int,name:string>>)), (u, p) ->
      transform(array(if(array_contains(u.used, p.slug), concat(p.slug, '_', {free}), p.slug)), name -> named_struct('used', array_append(u.used, name), 'out', array_append(u.out, named_struct('pid', p.pid, 'name', name))))[0])"""
    return f"""select doc_id, o.pid pid, o.name name from (select doc_id, explode({fold}.out) o from (
      select doc_id, array_sort(collect_list(named_struct('page', page, 'pid', pid, 'slug', slug, 'k', cast(k as int)))) ps, cast(count_if({d.like('slug', '_[0-9]+$')}) as int) numbered from (
        select *, row_number() over (partition by doc_id, slug order by page, pid) k from (select doc_id, page, pid, {slug} slug from fx_proposals) a) b group by doc_id) c) e"""


@operator
def confidence_bands(d: Spark) -> str:
    return "select source, case when confidence >= 0.75 then 'high' when confidence >= 0.5 then 'medium' else 'low' end band, count(*) n from fx_proposals group by all"


@operator
def form_summary(d: Spark) -> str:
    kinds = "text,multiline text,checkbox,radio,choice,signature,button".split(",")
    return "select doc_id, " + ", ".join(f"count_if(kind = '{k}') n_{k.replace(' ', '_')}" for k in kinds) + ", count(distinct page) pages, count_if(trim(value) <> '') filled, count_if(trim(value) = '') unfilled, count_if(read_only) locked from fx_fields group by doc_id"


@operator
def radio_groups(d: Spark) -> str:
    """Buttons of one name on a page are one field with their common box."""
    return """select doc_id, page, name, count(*) buttons, cast(min(x0) as double) x0, cast(min(y0) as double) y0, cast(max(x1) as double) x1, cast(max(y1) as double) y1, max(value) chosen from fx_fields where kind = 'radio' group by doc_id, page, name"""


# Answers that clear a group of buttons, and those that leave a box without its tick.
CLEARS = "off none no"
UNTICKED = "off no false 0 none unticked unchecked"
# End of fixed values.


@operator
def answer_validation(d: Spark) -> str:
    """What becomes of each answer, and the value that the field takes (null where it takes none).

    Several answers to one field stand between bars, as choices do. A text on one line loses its line breaks before its
    length counts. An option is taken as it stands, else without regard to case and outer blanks; a choice that may be
    edited takes any words, one that is not multiple a single answer. Buttons are cleared by a blank or a word for it.
    """
    options, given = d.split("coalesce(f.choices, '')", r"\|"), "coalesce(a.answer, '')"
    items = f"case when {given} = '' then {d.slice(d.array(d.text('')), 0)} else {d.split(given, r'\|')} end"
    if d.name == "spark":
        first = lambda test: f"get(filter({options}, o -> {test}), 0)"
        match = lambda i: f"coalesce({first(f'o = {i}')}, {first(f'lower(trim(o)) = lower(trim({i}))')}, case when f.editable then {i} end)"
        picked = f"transform({items}, i -> {match('i')})"
        has_null, count = "exists(picked, p -> p is null)", "size(picked)"
        button = first("lower(trim(o)) = plain")
    else:
        first = lambda test: f"list_filter({options}, lambda o: {test})[1]"
        match = lambda i: f"coalesce({first(f'o = {i}')}, {first(f'lower(trim(o)) = lower(trim({i}))')}, case when f.editable then {i} end)"
        picked = f"list_transform({items}, lambda i: {match('i')})"
        has_null, count = "len(list_filter(picked, lambda p: p is null)) > 0", "len(picked)"
        button = first("lower(trim(o)) = plain")
    broken = d.like("answer", r"[\n\r]")
    line = f"case when kind = 'text' and {broken} then {squeeze(d, 'answer')} else answer end"
    status = f"""case when no_field then 'no such field' when read_only then 'read only' when kind in ('signature', 'button') then 'refused'
        when kind in ('text', 'multiline text') and coalesce(max_len, 0) > 0 and length(line) > max_len then 'too long' when kind = 'text' and {broken} then 'squeezed'
        when kind = 'radio' and plain <> '' and plain not in ({words(CLEARS)}) and button is null then 'not an option'
        when kind = 'choice' and {count} > 1 and not multi then 'more than one' when kind = 'choice' and {has_null} then 'not an option' else 'taken' end"""
    value = f"""case when status not in ('taken', 'squeezed') then null when kind = 'checkbox' then case when plain = '' or plain in ({words(UNTICKED)}) then 'false' else 'true' end
        when kind = 'radio' then case when plain = '' or plain in ({words(CLEARS)}) then '' else button end when kind = 'choice' then {d.array_join('picked', '|')} else line end"""
    return f"""select doc_id, field_id, status, {value} value from (select *, {status} status from (select *, {line} line from (
      select *, {button.replace('f.choices', 'choices')} button from (
        select a.doc_id, a.field_id, {given} answer, lower(trim({given})) plain, f.doc_id is null no_field, f.kind, f.read_only, f.max_len, f.multi, f.choices, {picked} picked
        from fx_answers a left join fx_fields f on f.doc_id = a.doc_id and f.field_id = a.field_id) r) b) l) s"""


# Kinds that a box of a reply may have, kinds of proposals, and the confidence of those that give none.
BOX_KINDS = "text checkbox choice signature date"
PROPOSAL_KINDS = "text checkbox"
CONFIDENCE = 0.7
# End of fixed values.


def _listed(d: Spark) -> str:
    """The list in a model's reply, as text."""
    return d.extract("coalesce(reply, '')", r"(?s)\[.*\]", 0)


def _items(d: Spark) -> str:
    """The objects of a reply's list, for Spark; null for a reply without one."""
    return f"transform(from_json({_listed(d)}, 'array<string>'), x -> from_json(x, 'label string, kind string, confidence string, rect array<string>'))"


@stored
def offered_boxes(d: Spark) -> str:
    """(doc_id, page, n, label, kind, confidence, a, b, c, e): what the list in a model's reply holds, item by item. Words around the
    list do not matter. Items that are no objects, or numbers that are none, come as nulls; a reply without a list has no items."""
    if d.name == "duck":
        field = lambda path: f"json_extract_string(x, '{path}')"
        number = lambda path: d.number(field(path))
        items = f"(select doc_id, page, case when json_valid(arr) and json_type(arr) = 'ARRAY' then json_extract(arr, '$[*]') else [] end arr from (select doc_id, page, {_listed(d)} arr from fx_replies) r) s"
        return f"""select doc_id, page, cast(pos + 1 as int) n, {field('$.label')} as label, {field('$.kind')} kind, {number('$.confidence')} confidence, {number('$.rect[0]')} a, {number('$.rect[1]')} b, {number('$.rect[2]')} c, {number('$.rect[3]')} e
          from ({d.each(items, 'arr', 'doc_id, page')}) i"""
    number = lambda i: f"try_cast(get(o.rect, {i}) as double)"
    # items are read before they become rows: a filter on what they hold cannot have them read again
    return f"""select doc_id, page, cast(pos + 1 as int) n, o.label label, o.kind kind, try_cast(o.confidence as double) confidence, {', '.join(f'{number(i)} {c}' for i, c in enumerate('abce'))}
      from (select doc_id, page, pos, x o from ({d.each('fx_replies', _items(d), 'doc_id, page')}) i) j"""


def _real(of: str = "") -> str:
    """Whether an item has four numbers."""
    return " and ".join(f"not isnan({of}{c}) and abs({of}{c}) < 1e300" for c in "abce")


def _corners(of: str = "") -> dict[str, str]:
    """The corners of an item's box in order, held to the page g."""
    ends = {"x": (f"{of}a, {of}c", "g.width"), "y": (f"{of}b, {of}e", "g.height")}
    return {f"{axis}{i}": f"least(greatest({end}({two}), 0), {most})" for i, end in enumerate(("least", "greatest")) for axis, (two, most) in ends.items()}


#: What a box that is kept has: 4 points or more either way, no more than a quarter of the page high or large.
FITS = "x1 - x0 >= 4 and y1 - y0 >= 4 and y1 - y0 <= 0.25 * height and (x1 - x0) * (y1 - y0) <= 0.25 * width * height"


@view
def kept_boxes(d: Spark) -> str:
    """Items that are boxes on their page: corners put in order and held to the page, 4 points or more either way, no more than a
    quarter of the page high or large."""
    corners = ", ".join(f"{value} {name}" for name, value in _corners().items())
    return f"""select doc_id, page, n, trim(substr({squeeze(d, "coalesce(label, '')")}, 1, 120)) label, case when {kind_of('kind', BOX_KINDS)} then lower(trim(kind)) else 'text' end kind,
        case when confidence is null or isnan(confidence) then cast({CONFIDENCE} as double) else greatest(cast(0 as double), least(cast(1 as double), confidence)) end confidence, x0, y0, x1, y1 from (
      select o.*, g.width, g.height, {corners}
      from offered_boxes o join (select doc_id, page, cast(width as double) width, cast(height as double) height from fx_form_pages where width > 0 and height > 0) g on g.doc_id = o.doc_id and g.page = o.page where {_real()}) h
      where {FITS}"""


def kind_of(column: str, kinds: str) -> str:
    return f"lower(trim(coalesce({column}, ''))) in ({words(kinds)})"


@operator
def model_boxes(d: Spark) -> str:
    return "select doc_id, page, n, label, kind, x0, y0, x1, y1 from kept_boxes"


@operator
def model_box_counts(d: Spark) -> str:
    """Replies with how many boxes they offer and how many of these are kept; whether they hold a list at all."""
    if d.name == "spark":
        # items stay in their reply until the sizes of its page stand beside them, and only boxes that some page could keep have numbers
        number = lambda i: f"try_cast(get(o.rect, {i}) as double)"
        large = "abs(q.a - q.c) >= 4 and abs(q.b - q.e) >= 4"
        boxes = f"transform(items, o -> {let('q', d.struct(**{c: number(i) for i, c in enumerate('abce')}), f'case when {_real("q.")} and {large} then q end')})"
        box = let("k", d.struct(**_corners("b."), width="g.width", height="g.height"), re.sub(r"\b([xy][01]|width|height)\b", r"k.\1", FITS))
        hits = f"case when b is null or sizes is null then 0 else size(filter(sizes, g -> {box})) end"
        hits = f"case when doc_id is not null and page is not null and boxes is not null then transform(boxes, b -> {hits}) else cast(array() as array<int>) end"
        # replies of one page are joined with the items of all of them, as boxes are with those of their number; the first of them counts
        own = "partition by doc_id, page"
        numbered = "filter(transform(every, h -> get(h, i)), k -> k is not null)"
        alike = let("ks", numbered, let("sum", "aggregate(ks, 0L, (t, k) -> t + k)", d.struct(offered="size(ks) * greatest(sum, 1L)", kept="size(ks) * sum")))
        by_number = f"transform(sequence(0, array_max(transform(every, h -> size(h)))), i -> {alike})"
        total = lambda c: f"size(every) * aggregate(numbers, 0L, (t, x) -> t + x.{c}) {c}"
        return f"""select doc_id, page, {total('offered')}, {total('kept')} from (select doc_id, page, every, {by_number} numbers from (
          select doc_id, page, first, collect_list(hits) over ({own}) every from (
            select doc_id, page, first, {hits} hits from (
              select r.doc_id, r.page, r.first, r.boxes, s.sizes from (
                select doc_id, page, boxes, row_number() over ({own} order by page) first from (select doc_id, page, {boxes} boxes from (select doc_id, page, {_items(d)} items from fx_replies) i) o) r
              left join (select doc_id, page, sizes from (select doc_id, page, first, collect_list(named_struct('width', width, 'height', height)) over ({own}) sizes from (
                select doc_id, page, cast(width as double) width, cast(height as double) height, row_number() over ({own} order by page) first
                from fx_form_pages where width > 0 and height > 0) p) w where first = 1) s on s.doc_id = r.doc_id and s.page = r.page) j) h) e where first = 1) t"""
    return """select r.doc_id, r.page, count(o.n) offered, count(k.n) kept from fx_replies r left join offered_boxes o on o.doc_id = r.doc_id and o.page = r.page
      left join kept_boxes k on k.doc_id = o.doc_id and k.page = o.page and k.n = o.n group by r.doc_id, r.page"""


@operator
def model_proposals(d: Spark) -> str:
    """Kept boxes as proposals with their confidence; those without a label are numbered on their page, in the order of the reply."""
    return f"""select doc_id, page, n, case when {kind_of('kind', PROPOSAL_KINDS)} then kind else 'text' end kind, confidence, case when clean <> '' then clean else
        'Blank ' || cast(sum(case when clean = '' then 1 else 0 end) over (partition by doc_id, page order by n rows between unbounded preceding and current row) as string) || ' on page ' || cast(page as string) end label
      from (select *, {label(d, 'label')} clean from kept_boxes) k"""


@operator
def field_names_from_page(d: Spark) -> str:
    """A field without a name takes the words that end within 220 points left of it on its row, in order of x; without any, those
    that stand within 28 points above it."""
    left = f"""select f.doc_id, f.field_id, 1 place, w.x0 a, w.x0 b, w.word_id, w.text from {banded(d, 'fx_unnamed_fields', 'y0', 'y1')} f
      join {banded(d, 'fx_words', 'y0', 'y1')} w on w.doc_id = f.doc_id and w.page = f.page and {meet(d, 'f', 'w')} and w.y1 >= f.y0 and w.y0 <= f.y1 and w.x1 <= f.x0 + 2 and f.x0 - w.x1 < 220"""
    above = f"""select f.doc_id, f.field_id, 2 place, w.y0 a, w.x0 b, w.word_id, w.text from {banded(d, 'fx_unnamed_fields', 'y0 - 28', 'y0 + 2')} f
      join {banded(d, 'fx_words', 'y1', 'y1')} w on w.doc_id = f.doc_id and w.page = f.page and {meet(d, 'f', 'w')} and w.y1 <= f.y0 + 2 and f.y0 - w.y1 < 28 and w.x1 >= f.x0 and w.x0 <= f.x1"""
    return f"""select doc_id, field_id, trim(substr({d.sub(squeeze(d, d.join('text', ' ', 'a, b, word_id')), '[_.: ]+$')}, 1, 120)) name from (
      select *, min(place) over (partition by doc_id, field_id) best from ({left} union all {above}) c) n where place = best group by doc_id, field_id"""


@view
def row_heights(d: Spark) -> str:
    """(doc_id, page, band): how far from the first of its row an item may stand: 0.6 of the page's upper median height, from 4 to 20 points, 8 where nothing has a height."""
    return """select p.doc_id, p.page, coalesce(m.band, cast(8 as double)) band from (select distinct doc_id, page from fx_proposals) p left join (
      select doc_id, page, greatest(cast(4 as double), least(cast(20 as double), 0.6 * max(case when i = cast(floor(n / 2) as bigint) + 1 then h end))) band from (
        select doc_id, page, h, row_number() over (partition by doc_id, page order by h) i, count(*) over (partition by doc_id, page) n from (select doc_id, page, cast(y1 - y0 as double) h from fx_proposals) a where h > 0) b group by doc_id, page) m
      on m.doc_id = p.doc_id and m.page = p.page"""


@operator
def row_reading_order(d: Spark) -> str:
    """Rows by the first item's y: an item within the page's band of its row's first one belongs to it; then by x."""
    if d.name == "spark":
        item = "named_struct('row_no', {0}, 'x0', p.x0, 'pid', p.pid)"
        fold = f"""aggregate(ps, named_struct('row', 0, 'y', cast(null as double), 'out', cast(array() as array<struct<row_no:int,x0:double,pid:int>>)), (acc, p) ->
          if(acc.y is null or p.y0 - acc.y > band, named_struct('row', acc.row + 1, 'y', p.y0, 'out', array_append(acc.out, {item.format('acc.row + 1')})),
             named_struct('row', acc.row, 'y', acc.y, 'out', array_append(acc.out, {item.format('acc.row')}))), acc -> array_sort(acc.out))"""
        return f"""select doc_id, page, o.pid pid, o.row_no row_no, cast(pos + 1 as int) read_ord from (select doc_id, page, {fold} items from (
          select p.doc_id, p.page, max(h.band) band, array_sort(collect_list(named_struct('y0', cast(y0 as double), 'x0', cast(x0 as double), 'pid', cast(pid as int)))) ps
          from fx_proposals p join row_heights h on h.doc_id = p.doc_id and h.page = p.page group by p.doc_id, p.page) g) a lateral view posexplode(items) e as pos, o"""
    return """with recursive hs as (select doc_id, page, list_sort(list(cast(y1 - y0 as double)) filter (where y1 > y0)) h from fx_proposals group by doc_id, page),
      s as (select p.doc_id, p.page, cast(pid as int) pid, cast(x0 as double) x0, cast(y0 as double) y0, case when h is null then 8 else greatest(4, least(20, 0.6 * h[len(h) // 2 + 1])) end band, row_number() over (partition by p.doc_id, p.page order by y0, x0, pid) i
        from fx_proposals p join hs on hs.doc_id = p.doc_id and hs.page = p.page),
      r as (select doc_id, page, pid, x0, i, 1 row_no, y0 y from s where i = 1
        union all select s.doc_id, s.page, s.pid, s.x0, s.i, r.row_no + case when s.y0 - r.y > s.band then 1 else 0 end, case when s.y0 - r.y > s.band then s.y0 else r.y end from s join r on r.doc_id = s.doc_id and r.page = s.page and s.i = r.i + 1)
      select doc_id, page, pid, cast(row_no as int) row_no, cast(row_number() over (partition by doc_id, page order by row_no, x0, pid) as int) read_ord from r"""
