"""Which files are readable, flat, faulty or sound, and what to do next."""

from __future__ import annotations

from marginalia.functions.dialect import Spark

from .base import bad_share, operator, stored, view


@operator
def text_quality(d: Spark) -> str:
    return f"select doc_id, {bad_share(d, 'text')} bad_share from (select doc_id, coalesce(text, '') text from fx_symbol_texts) t"


@stored
def page_kinds(d: Spark) -> str:
    return f"""select doc_id, page, case when length(trim(coalesce(text, ''))) > 0 and {bad_share(d, "coalesce(text, '')")} >= 0.15 then 'garbled'
      when length(trim(coalesce(text, ''))) > 0 then 'text' when images > 0 then 'scanned' else 'blank' end kind from fx_pdf_pages"""


@operator
def classify_pages(d: Spark) -> str:
    return "select doc_id, page, kind from page_kinds"


@view
def kind_counts(d: Spark) -> str:
    return "select doc_id, " + ", ".join(f"count_if(kind = '{k}') {k}_pages" for k in ("text", "scanned", "garbled", "blank")) + ", count(*) pages from page_kinds group by doc_id"


@operator
def page_kind_counts(d: Spark) -> str:
    return "select doc_id, text_pages, scanned_pages, garbled_pages, blank_pages, pages from kind_counts"


@view
def triage(d: Spark) -> str:
    """The level is the first that applies: no readable page at all comes before readable pages among others."""
    return """select k.doc_id, case when not d.readable then 'unreadable' when k.text_pages + k.scanned_pages + k.garbled_pages = 0 then 'empty'
        when k.text_pages = 0 then 'pictures' when k.scanned_pages + k.garbled_pages > 0 then 'partly'
        when g.flat then 'flat' when not g.gate then 'faults' else 'good' end level, g.repairable, g.silent_pictures, g.no_form, g.has_fields, d.producer
      from kind_counts k join fx_docs d on d.doc_id = k.doc_id left join gates g on g.doc_id = k.doc_id"""


@operator
def triage_level(d: Spark) -> str:
    return "select doc_id, level from triage"


@operator
def triage_steps(d: Spark) -> str:
    """What to do, in order. Of a file that cannot be opened a new copy is asked for, and nothing else."""
    first = "case when level in ('unreadable', 'empty') then 'resend' when level in ('pictures', 'partly') then 'open' when level = 'flat' then 'rebuild' end"
    opened = "level <> 'unreadable'"
    steps = d.compact(
        first,
        f"case when {opened} and repairable then 'repair' end",
        f"case when {opened} and silent_pictures then 'pictures' end",
        f"case when {opened} and no_form then 'other form' when {opened} and has_fields then 'fill in' end",
        "case when level = 'faults' then 'rebuild' end",
        f"case when {opened} then 'full check' end",
    )
    return f"select doc_id, {d.array_join(steps, ', ')} steps from triage"


@operator
def triage_rollup(d: Spark) -> str:
    return "select producer, level, count(*) n, cast(count(*) as double) / sum(count(*)) over () share from triage group by producer, level"
