"""Checks of structured documents: one verdict a document and check, from tables of elements, pages, fonts and annotations."""

from __future__ import annotations

from marginalia.functions.dialect import Spark

from .base import SPACE, UNREADABLE, bad_share, is_lang, operator, squeeze, view, words

# Structure types of the standard, what some others map to, and headings.
STANDARD = (
    "Document Part Art Sect Div BlockQuote Caption TOC TOCI Index NonStruct Private P H H1 H2 H3 H4 H5 H6 L LI Lbl LBody Table TR TH TD THead TBody TFoot "
    "Span Quote Note Reference BibEntry Code Link Annot Ruby RB RT RP Warichu WT WP Figure Formula Form"
)
KNOWN_ROLES = {"Strong": "Span", "Em": "Span", "Title": "P", "Aside": "Div", "FENote": "Note", "Sub": "Span"}
# End of fixed values.


def standard() -> str:
    return words(" ".join(f"/{t}" for t in STANDARD.split()))


def _check(key: str, passed: str, source: str = "fx_docs", warn: bool = False, bad: str = "cast(0 as bigint)", total: str = "cast(0 as bigint)") -> str:
    return f"select doc_id, '{key}' key, {passed} passed, {str(warn).lower()} warn_only, cast({bad} as bigint) bad, cast({total} as bigint) total from {source}"


def _counted(key: str, table: str, bad: str, of: str = "true", warn: bool = False, only_with: bool = False) -> str:
    """No row of the kind may be bad. Documents without one pass, or have no such check."""
    counts = f"(select doc_id, count_if({of}) total, count_if(({of}) and ({bad})) bad from {table} group by doc_id)"
    if only_with:
        return f"select doc_id, '{key}' key, bad = 0 passed, {str(warn).lower()} warn_only, bad, total from {counts} c where total > 0"
    return f"""select d.doc_id, '{key}' key, coalesce(c.bad, 0) = 0 passed, {str(warn).lower()} warn_only, coalesce(c.bad, 0) bad, coalesce(c.total, 0) total
      from fx_docs d left join {counts} c on c.doc_id = d.doc_id"""


CHECKS = {}


def check(f):
    """A check reads only readable documents; it is an operator of its own and part of the report."""
    name = f.__name__.removeprefix("chk_")

    def sql(d: Spark) -> str:
        return f"select * from ({f(d)}) c where doc_id in (select doc_id from fx_docs where readable)" if name != "readable" else f(d)

    sql.__name__ = f.__name__
    CHECKS[name] = sql
    return operator(sql)


@check
def chk_readable(d: Spark) -> str:
    return _check("readable", "readable")


@check
def chk_tagged(d: Spark) -> str:
    return _check("tagged", "marked")


@check
def chk_tree(d: Spark) -> str:
    return "select d.doc_id, 'tree' key, coalesce(n, 0) > 0 passed, false warn_only, cast(0 as bigint) bad, coalesce(n, 0) total from fx_docs d left join (select doc_id, count(*) n from fx_elems group by doc_id) e on e.doc_id = d.doc_id"


@check
def chk_lang(d: Spark) -> str:
    return _check("lang", is_lang(d, "trim(coalesce(lang, ''))"))


@check
def chk_display_title(d: Spark) -> str:
    return _check("display_title", "display_title")


@check
def chk_title(d: Spark) -> str:
    """A title in the metadata stream; one in the information dictionary alone fails (bad = 1)."""
    return _check("title", "trim(coalesce(xmp_title, '')) <> ''", bad="case when trim(coalesce(xmp_title, '')) = '' and trim(coalesce(info_title, '')) <> '' then 1 else 0 end")


@check
def chk_identifier(d: Spark) -> str:
    return _check("identifier", "coalesce(part_id, '') = '1'")


@check
def chk_figures(d: Spark) -> str:
    return _counted("figures", "fx_elems", "trim(coalesce(alt, '')) = '' and trim(coalesce(actual_text, '')) = ''", "kind = '/Figure'")


@view
def heading_elems(d: Spark) -> str:
    level = "cast(substr(kind, 3, 1) as int)"
    return f"select doc_id, elem_id, {level} level, lag({level}, 1, 0) over (partition by doc_id order by elem_id) previous from fx_elems where {d.like('kind', r'^/H[1-6]$')}"


@check
def chk_headings(d: Spark) -> str:
    """Levels never deepen by more than one, from 0 on; bad is the first offending element."""
    return """select d.doc_id, 'headings' key, first_bad is null passed, false warn_only, cast(coalesce(first_bad, 0) as bigint) bad, coalesce(total, 0) total from fx_docs d
      left join (select doc_id, min(case when level > previous + 1 then elem_id end) first_bad, count(*) total from heading_elems group by doc_id) h on h.doc_id = d.doc_id"""


@check
def chk_fonts(d: Spark) -> str:
    return _counted("fonts", "fx_fonts", "not has_file and subtype <> '/Type3'")


@operator
def font_names(d: Spark) -> str:
    """Up to six fonts that are not embedded, sorted, without the prefix of a subset."""
    name = d.sub("font_name", r"^[A-Z]{6}\+")
    return f"select doc_id, {d.array_join(d.slice(d.distinct(name, 'not has_file and subtype <> ' + chr(39) + '/Type3' + chr(39)), 6), ', ')} names from fx_fonts group by doc_id"


@check
def chk_tabs(d: Spark) -> str:
    pages = "(select p.doc_id, p.tabs from fx_pdf_pages p where exists (select 1 from fx_annots a where a.doc_id = p.doc_id and a.page = p.page))"
    return _counted("tabs", f"{pages} tp", "coalesce(tabs, '') <> '/S'")


@check
def chk_links(d: Spark) -> str:
    return _counted("links", "fx_annots", "not has_struct_parent", "subtype = '/Link'")


@check
def chk_link_contents(d: Spark) -> str:
    return _counted("link_contents", "fx_annots", "trim(coalesce(contents, '')) = ''", "subtype = '/Link'", only_with=True)


@check
def chk_outline(d: Spark) -> str:
    return _check("outline", "outline", warn=True)


@check
def chk_text(d: Spark) -> str:
    return """select d.doc_id, 'text' key, coalesce(chars, 0) > 0 passed, false warn_only, cast(coalesce(images, 0) as bigint) bad, cast(coalesce(chars, 0) as bigint) total from fx_docs d
      left join (select doc_id, sum(chars) chars, sum(images) images from fx_pdf_pages group by doc_id) p on p.doc_id = d.doc_id"""


@check
def chk_untagged(d: Spark) -> str:
    return "select doc_id, 'untagged' key, sum(untagged) = 0 passed, false warn_only, cast(sum(untagged) as bigint) bad, cast(sum(chars) as bigint) total from fx_pdf_pages group by doc_id having sum(chars) > 0"


@check
def chk_lbody(d: Spark) -> str:
    items = "(select i.doc_id, b.parent_id from fx_elems i left join (select distinct doc_id, parent_id from fx_elems where kind = '/LBody') b on b.doc_id = i.doc_id and b.parent_id = i.elem_id where i.kind = '/LI')"
    return _counted("lbody", f"{items} li", "parent_id is null", warn=True)


@check
def chk_suspects(d: Spark) -> str:
    return _check("suspects", "not suspects", "fx_docs where doc_id in (select doc_id from fx_elems)")


@check
def chk_roles(d: Spark) -> str:
    """Kinds that are not standard once the role map is followed."""
    kinds = f"(select distinct r.doc_id, r.kind, r.resolved in ({standard()}) known from role_chain r)"
    return _counted("roles", f"{kinds} rk", "not known", only_with=True)


@operator
def unknown_kinds(d: Spark) -> str:
    """How many kinds of a document are not standard, and the first six by name."""
    kinds = f"(select distinct doc_id, substr(kind, 2) kind from role_chain where not (resolved in ({standard()})) and kind <> '') k"
    return f"select doc_id, count(*) n, {d.array_join(d.slice(d.distinct('kind'), 6), ', ')} names from {kinds} group by doc_id"


@check
def chk_artifacts(d: Spark) -> str:
    return _counted("artifacts", "fx_pdf_pages", "unmarked > 0")


@view
def headed_tables(d: Spark) -> str:
    """(doc_id, elem_id, th): every table with the number of header cells below it."""
    return "select doc_id, elem_id, headers th from elem_totals where kind = '/Table'"


@check
def chk_table_headers(d: Spark) -> str:
    return _counted("table_headers", "headed_tables", "th = 0", only_with=True)


@check
def chk_xfa(d: Spark) -> str:
    return _check("xfa", "false", "fx_docs where xfa")


@check
def chk_fields(d: Spark) -> str:
    return _counted("fields", "field_tips", "not named", only_with=True)


@check
def chk_fields_tagged(d: Spark) -> str:
    return _counted("fields_tagged", "fx_annots", "not has_struct_parent", "subtype = '/Widget'", only_with=True)


@check
def chk_annotations(d: Spark) -> str:
    return _counted("annotations", "fx_annots", "trim(coalesce(contents, '')) = ''", "subtype not in ('/Link', '/Widget', '/Popup', '/PrinterMark')", only_with=True)


@check
def chk_unicode(d: Spark) -> str:
    fonts = "(select f.* from fx_fonts f where f.doc_id in (select doc_id from fx_pdf_pages group by doc_id having sum(chars) > 0))"
    return _counted("unicode", f"{fonts} ff", _unmapped_font(d), only_with=True)


@check
def chk_garbled(d: Spark) -> str:
    text = d.join("text", " ", "page", "page <= 40")
    return f"""select doc_id, 'garbled' key, {bad_share(d, 'text')} < 0.15 passed, false warn_only, cast(0 as bigint) bad, cast(length(text) as bigint) total
      from (select doc_id, coalesce({text}, '') text from fx_pdf_pages group by doc_id having sum(chars) > 0) g"""


@check
def chk_permissions(d: Spark) -> str:
    return _check("permissions", "allow_access or allow_extract", "fx_docs where encrypted")


# The order of the checks in a report.
ORDER = (
    "readable tagged tree lang display_title title identifier figures headings fonts tabs links link_contents outline text untagged lbody suspects roles "
    "artifacts table_headers xfa fields fields_tagged annotations unicode garbled permissions"
)
# End of fixed values.


# The report reads each table once: its counts by document are joined, and a document's row becomes its checks.


@view
def element_counts(d: Spark) -> str:
    """(doc_id, elements, figures, bad_figures, headings, first_bad, items, loose_items, kinds) of every document's elements. All are sums
    and sets, so that a task's elements meet the others as one row a document; of headings it has their levels in order."""
    level = f"case when {d.like('kind', r'^/H[1-6]$')} then cast(substr(kind, 3, 1) as int) end"
    figure = "kind = '/Figure'"
    deeper = "case when x.level > 1 + case when i = 0 then 0 else levels[i - 1].level end then x.elem_id end"
    return f"""select doc_id, elements, figures, bad_figures, headings, array_min(transform(levels, (x, i) -> {deeper})) first_bad, items, loose_items, kinds from (
      select doc_id, count(*) elements, count_if({figure}) figures, count_if({figure} and silent) bad_figures, count(level) headings, count_if(kind = '/LI') items,
        sort_array(collect_list(case when level is not null and elem_id is not null then named_struct('elem_id', elem_id, 'level', level) end)) levels,
        size(array_except(collect_set(case when kind = '/LI' then elem_id end), collect_set(case when kind = '/LBody' then parent_id end))) loose_items, collect_set(kind) kinds
      from (select doc_id, elem_id, parent_id, kind, {level} level, trim(coalesce(alt, '')) = '' and trim(coalesce(actual_text, '')) = '' silent from fx_elems) e group by doc_id) h"""


@view
def table_counts(d: Spark) -> str:
    return "select doc_id, count(*) tables, count_if(th = 0) bad_tables from headed_tables group by doc_id"


@view
def role_maps(d: Spark) -> str:
    return "select doc_id, array_sort(collect_set(named_struct('a', from_kind, 'b', to_kind))) roles from fx_rolemap group by doc_id"


@view
def page_counts(d: Spark) -> str:
    """Of the first 40 pages' text, joined by a space: how long it is, how many of its characters are not white space, and how many of these
    no reader can use. Characters count one by one, so that pages add up and no text is put together."""
    near = "case when page <= 40 then text end"
    return f"""select doc_id, count(*) pages, cast(sum(chars) as bigint) chars, cast(sum(images) as bigint) images, cast(sum(untagged) as bigint) untagged, count_if(unmarked > 0) unmarked,
        collect_list(page) page_list, collect_list(case when coalesce(tabs, '') <> '/S' then page end) bad_tabs,
        coalesce(sum(length(near)) + count(near) - 1, 0) text_length, coalesce(sum(length(solid)), 0) solid_chars, coalesce(sum({d.count('solid', UNREADABLE)}), 0) unreadable
      from (select *, {d.sub('near', SPACE, '')} solid from (select *, {near} near from fx_pdf_pages) p) s group by doc_id"""


def _unmapped_font(d: Spark) -> str:
    """Fonts whose codes map to letters: by their own table, by a named encoding, or as one of the base fonts."""
    base = d.like(d.sub("font_name", r"^[A-Z]{6}\+"), r"^(Helvetica|Times|Courier)")
    return f"not (has_tounicode or encoding is not null or (subtype in ('/Type1', '/TrueType') and {base}))"


@view
def font_counts(d: Spark) -> str:
    return f"select doc_id, count(*) fonts, count_if(not has_file and subtype <> '/Type3') bad_fonts, count_if({_unmapped_font(d)}) unmapped from fx_fonts group by doc_id"


@view
def annot_counts(d: Spark) -> str:
    other = "subtype not in ('/Link', '/Widget', '/Popup', '/PrinterMark')"
    silent = "trim(coalesce(contents, '')) = ''"
    return f"""select doc_id, count_if(subtype = '/Link') links, count_if(subtype = '/Link' and not has_struct_parent) untagged_links, count_if(subtype = '/Link' and {silent}) silent_links,
        count_if(subtype = '/Widget') widgets, count_if(subtype = '/Widget' and not has_struct_parent) untagged_widgets, count_if({other}) others, count_if({other} and {silent}) silent_others, collect_set(page) annot_pages
      from fx_annots group by doc_id"""


@view
def field_counts(d: Spark) -> str:
    return "select doc_id, count(*) fields, count_if(not named) unnamed from field_tips group by doc_id"


def _checks_of_a_row(d: Spark) -> str:
    """The checks as an array of (ord, key, applies, passed, warn_only, bad, total), from a document's counts."""
    n = lambda c: f"coalesce({c}, 0)"
    walk = "aggregate(sequence(1, greatest(1, coalesce(size(roles), 0))), named_struct('at', k, 'seen', array(k)), (w, i) -> coalesce(get(transform(filter(roles, r -> r.a = w.at and not array_contains(w.seen, r.b)), r -> named_struct('at', r.b, 'seen', concat(w.seen, array(r.b)))), 0), w), w -> w.at)"
    odd_kinds = f"size(filter(kinds, k -> {walk} not in ({standard()})))"
    of = {
        "readable": ("true", "readable", "0", "0"),
        "tagged": ("readable", "marked", "0", "0"),
        "tree": ("readable", f"{n('elements')} > 0", "0", n("elements")),
        "lang": ("readable", is_lang(d, "trim(coalesce(lang, ''))"), "0", "0"),
        "display_title": ("readable", "display_title", "0", "0"),
        "title": ("readable", "trim(coalesce(xmp_title, '')) <> ''", "case when trim(coalesce(xmp_title, '')) = '' and trim(coalesce(info_title, '')) <> '' then 1 else 0 end", "0"),
        "identifier": ("readable", "coalesce(part_id, '') = '1'", "0", "0"),
        "figures": ("readable", f"{n('bad_figures')} = 0", n("bad_figures"), n("figures")),
        "headings": ("readable", "first_bad is null", n("first_bad"), n("headings")),
        "fonts": ("readable", f"{n('bad_fonts')} = 0", n("bad_fonts"), n("fonts")),
        "tabs": ("readable", f"{n('bad_tab_pages')} = 0", n("bad_tab_pages"), n("tab_pages")),
        "links": ("readable", f"{n('untagged_links')} = 0", n("untagged_links"), n("links")),
        "link_contents": ("readable and links > 0", "silent_links = 0", "silent_links", "links"),
        "outline": ("readable", "outline", "0", "0"),
        "text": ("readable", f"{n('chars')} > 0", n("images"), n("chars")),
        "untagged": ("readable and chars > 0", "untagged = 0", "untagged", "chars"),
        "lbody": ("readable", f"{n('loose_items')} = 0", n("loose_items"), n("items")),
        "suspects": ("readable and elements > 0", "not suspects", "0", "0"),
        "roles": ("readable and size(kinds) > 0", f"{odd_kinds} = 0", odd_kinds, "size(kinds)"),
        "artifacts": ("readable", f"{n('unmarked')} = 0", n("unmarked"), n("pages")),
        "table_headers": ("readable and tables > 0", "bad_tables = 0", "bad_tables", "tables"),
        "xfa": ("readable and xfa", "false", "0", "0"),
        "fields": ("readable and fields > 0", "unnamed = 0", "unnamed", "fields"),
        "fields_tagged": ("readable and widgets > 0", "untagged_widgets = 0", "untagged_widgets", "widgets"),
        "annotations": ("readable and others > 0", "silent_others = 0", "silent_others", "others"),
        "unicode": ("readable and chars > 0 and fonts > 0", "unmapped = 0", "unmapped", "fonts"),
        "garbled": ("readable and chars > 0", "case when solid_chars = 0 then true else cast(unreadable as double) / solid_chars < 0.15 end", "0", "text_length"),
        "permissions": ("readable and encrypted", "allow_access or allow_extract", "0", "0"),
    }
    rows = [
        f"named_struct('ord', {i}, 'key', '{k}', 'applies', {of[k][0]}, 'passed', {of[k][1]}, 'warn_only', {str(k in ('outline', 'lbody')).lower()}, 'bad', cast({of[k][2]} as bigint), 'total', cast({of[k][3]} as bigint))"
        for i, k in enumerate(ORDER.split())
    ]
    return f"array({', '.join(rows)})"


@view
def all_checks(d: Spark) -> str:
    """Every check of every document. The check of this in DuckDB is the union of the single checks, each over its own tables."""
    if d.name == "duck":
        rest = " union all ".join(f"select doc_id, key, passed, warn_only, bad, total, {i} ord from ({CHECKS[k](d)}) c{i}" for i, k in enumerate(ORDER.split()) if k != "readable")
        return f"select doc_id, key, passed, warn_only, bad, total, 0 ord from ({CHECKS['readable'](d)}) c0 union all {rest}"
    counts = "element_counts table_counts role_maps page_counts font_counts annot_counts field_counts".split()
    joins = " ".join(f"left join {c} using (doc_id)" for c in counts)
    facts = f"select *, size(array_intersect(page_list, annot_pages)) tab_pages, size(array_intersect(bad_tabs, annot_pages)) bad_tab_pages from fx_docs {joins}"
    return f"select doc_id, x.key, x.passed, x.warn_only, x.bad, x.total, x.ord from (select doc_id, explode({_checks_of_a_row(d)}) x from ({facts}) f) e where x.applies"


@operator
def report_union(d: Spark) -> str:
    return "select doc_id, ord, key, passed, warn_only, bad, total from all_checks"


@operator
def report_score(d: Spark) -> str:
    return """select doc_id, passed, total, warnings, case when failed > 0 then 'FAIL' when warnings > 0 then 'WARN' else 'PASS' end word from (
      select doc_id, count_if(passed) passed, count(*) total, count_if(warn_only and not passed) warnings, count_if(not warn_only and not passed) failed from all_checks group by doc_id) s"""


# Checks whose fault a repair mends.
REPAIRABLE = "title lang display_title link_contents fields tabs"
# End of fixed values.


@view
def gates(d: Spark) -> str:
    bad = "not passed and not warn_only and key <> 'identifier'"
    failed = lambda keys: f"count_if(key in ({words(keys)}) and not passed) > 0"
    return f"""select doc_id, count_if({bad}) = 0 gate, {d.array_join(d.collect('key', 'ord', bad), ', ')} failed_names, count_if(key = 'identifier' and passed) > 0 claimed,
      {failed('tree tagged')} flat, {failed(REPAIRABLE)} repairable, {failed('figures')} silent_pictures, {failed('xfa')} no_form, count_if(key = 'fields') > 0 has_fields from all_checks group by doc_id"""


@operator
def report_gate(d: Spark) -> str:
    return "select doc_id, gate, failed_names from gates"


@operator
def claim_audit(d: Spark) -> str:
    """Documents that claim the identifier with the gate closed, and those that could and do not."""
    return "select doc_id, claimed, gate, case when claimed and not gate then 'false claim' when gate and not claimed then 'could claim' else 'as it is' end verdict from gates"


@view
def role_walk(d: Spark) -> str:
    """The check's kinds with the kinds that their document's role map leads to, a step a row; a cycle ends where it comes back."""
    return """select doc_id, kind, kind at_kind, [kind] seen, 0 step from (select distinct doc_id, kind from fx_elems) k
      union all select w.doc_id, w.kind, m.to_kind, list_append(w.seen, m.to_kind), w.step + 1 from role_walk w join fx_rolemap m on m.doc_id = w.doc_id and m.from_kind = w.at_kind where not list_contains(w.seen, m.to_kind)"""


@view
def kind_maps(d: Spark) -> str:
    return """select doc_id, map_from_entries(collect_list(named_struct('k', from_kind, 'v', to_kind))) roles from (
      select doc_id, from_kind, min(to_kind) to_kind from fx_rolemap where from_kind is not null group by doc_id, from_kind) r group by doc_id"""


def followed(kind: str) -> str:
    """A kind followed through its document's ``roles``, in Spark."""
    step = "case when roles[way.at] is null or array_contains(way.seen, roles[way.at]) then way else named_struct('at', roles[way.at], 'seen', array_append(way.seen, roles[way.at])) end"
    return f"case when roles is null then {kind} else aggregate(sequence(1, size(roles)), named_struct('at', {kind}, 'seen', array({kind})), (way, i) -> {step}).at end"


@view
def role_chain(d: Spark) -> str:
    """(doc_id, kind, resolved): kinds followed through their document's role map, however long the way; a cycle ends where it comes back."""
    if d.name == "duck":
        return "select doc_id, kind, max_by(at_kind, step) resolved from role_walk group by doc_id, kind"
    return f"select k.doc_id, k.kind, {followed('k.kind')} resolved from (select distinct doc_id, kind from fx_elems) k left join kind_maps m on m.doc_id = k.doc_id"


@operator
def role_resolution(d: Spark) -> str:
    return "select doc_id, kind, resolved from role_chain"


@operator
def page_inheritance(d: Spark) -> str:
    """An element's page: its own, else its nearest ancestor's, else that of the first element below it that has one."""
    later = "over (partition by doc_id order by enter rows between current row and unbounded following)"
    place = "case when own_page is not null then enter end"
    return f"""select e.doc_id, e.elem_id, coalesce(o.page, e.page) page from fx_elems e left join (
      select doc_id, elem_id, coalesce(page, case when min({place}) {later} < leave then min_by(own_page, {place}) {later} end) page from elem_order) o on o.doc_id = e.doc_id and o.elem_id = e.elem_id"""


@operator
def element_text(d: Spark) -> str:
    return "select doc_id, elem_id, text from texts_below"


@operator
def role_mapping_plan(d: Spark) -> str:
    """What kinds that are neither standard nor mapped would be mapped to."""
    known = "case " + " ".join(f"when e.kind = '/{a}' then '/{b}'" for a, b in KNOWN_ROLES.items()) + " else '/Span' end"
    return f"""select distinct e.doc_id, e.kind, {known} target from fx_elems e left join fx_rolemap m on m.doc_id = e.doc_id and m.from_kind = e.kind
      where m.doc_id is null and e.kind not in ({standard()})"""


@operator
def list_body_plan(d: Spark) -> str:
    """List items with children that are neither label nor body: what the body to be made would hold."""
    return """select i.doc_id, i.elem_id li_id, count_if(c.kind = '/Lbl') labels, count_if(c.kind not in ('/Lbl', '/LBody')) loose
      from fx_elems i join fx_elems c on c.doc_id = i.doc_id and c.parent_id = i.elem_id where i.kind = '/LI' group by i.doc_id, i.elem_id having count_if(c.kind not in ('/Lbl', '/LBody')) > 0"""


@operator
def link_descriptions(d: Spark) -> str:
    """Link elements with their text, beside the document's link annotations in order."""
    texts = "(select * from texts_below where kind = '/Link')" if d.name == "spark" else "texts_below"
    return f"""select e.doc_id, e.elem_id, e.n, a.annot_id, t.text from (select doc_id, elem_id, row_number() over (partition by doc_id order by elem_id) n from fx_elems where kind = '/Link') e
      join (select doc_id, annot_id, row_number() over (partition by doc_id order by page, annot_id) n from fx_annots where subtype = '/Link') a on a.doc_id = e.doc_id and a.n = e.n
      left join {texts} t on t.doc_id = e.doc_id and t.elem_id = e.elem_id"""


@operator
def artifact_plan(d: Spark) -> str:
    """Painting outside marked content, by running depth that does not fall below 0."""
    step = "case op when 'BDC' then 1 when 'EMC' then -1 else 0 end"
    return f"""select doc_id, page, seq, op from (
      select *, level - least(0, min(level) over (partition by doc_id, page order by seq rows between unbounded preceding and current row)) depth from (
        select *, sum({step}) over (partition by doc_id, page order by seq rows between unbounded preceding and current row) level from fx_ops) a) b
      where depth = 0 and op in ('f', 'S', 'sh', 'Do')"""
