"""Pages put together again as a tidy tree: one fold over a page's tokens that carries the open elements.

The state is the path of open elements, the tags not written yet, and the white space that waits for more text. Each token closes
what it implies (a pattern over the end of the path), opens what it needs (a paragraph around bare text, an item in a list, a row
and body in a table), and gives a piece of the page. Tags are written only when something to see comes, so empty blocks never
appear; an item that was closed stays until the next one, so that a list straight after it joins it.

Marks before a name in the path: ``-`` open but not written, ``+`` written, ``,`` and ``.`` the same for an item that was closed.
The fold goes over slices of a page, so that its work grows no faster than the page does. DuckDB's check makes the same steps as a
recursive query, a token a level.
"""

from __future__ import annotations

from marginalia.functions.dialect import Spark

from .base import decoded, is_lang, operator, squeeze, view, words
from .html import CONTAINERS, HEADINGS, KEPT, MAPPED, attributes_of, link_verdict, tokens_of, undropped_of

#: Tokens of a page that one inner fold takes.
SLICE = 128

# Elements of running text, and picture data that a page may hold.
INLINE = "strong em u s code sup sub a"
PICTURE = r"(?i)^data:image/(png|jpeg|jpg|gif|webp|bmp);base64,"
# End of fixed values.

SPACE = r"[ \t\n\r\f\x{0B}\x{A0}\x{200B}\x{200C}\x{200D}\x{FEFF}]"


#: Kinds of elements, by their names after mapping; others are unwrapped.
CLASSES = {"list": "ul ol", "li": "li", "cell": "td th", "row": "tr", "section": "thead tbody tfoot", "br": "br", "img": "img", "hr": "hr", "pre": "pre", "inline": INLINE, "box": CONTAINERS + " dt dd", "block": HEADINGS + " p blockquote figure figcaption table caption"}


#: What takes nothing off a path.
NOTHING = " !$"


def rules() -> list[tuple[str, str, str, str, str]]:
    """(tag, t, c, cut_open, cut_close) of every element: its name and class, and the patterns that take what its open or close implies off
    the path. Texts have the empty name."""
    any_of = lambda names: f"(?: [^ ](?:{'|'.join(names.split())}))*"
    without = lambda *tags: " ".join(t for t in KEPT.split() if t not in tags)
    text, nothing = any_of(f"{INLINE} p {HEADINGS}"), NOTHING
    opens = {"inline": " [.,]li$", "img": " [.,]li$", "list": f"{text}$", "li": f" [^ ]li{any_of(without('ul', 'ol'))}$", "cell": f" [^ ](?:td|th){any_of(without('table'))}$",
             "row": f" [^ ]tr{any_of(without('table'))}$", "section": f" [^ ](?:thead|tbody|tfoot){any_of(without('table'))}$"} | {c: f"{text}(?: [.,]li)?$" for c in ("block", "box", "pre", "hr")}
    names = {t: t for c in CLASSES.values() for t in c.split()}
    names |= {a: b for a, b in MAPPED.items() if a not in names}
    kinds = {t: c for c, ts in CLASSES.items() for t in ts.split()}
    rows = [("", "", "text", " [.,]li$", nothing)]
    for tag, t in names.items():
        close = {"inline": f" [^ ]{t}{any_of(INLINE)}$", "box": f"{text}$", "li": "^(.* [^ ]li)(?: .*)?$"}.get(kinds[t], f"^(.*) [^ ]{t}(?: .*)?$")
        rows.append((tag, t, kinds[t], opens.get(kinds[t], nothing), close))
    return rows


def cuts() -> list[str]:
    """Every pattern once; Spark's tokens carry its number, so that each is compiled once a task."""
    return list(dict.fromkeys(p for r in rules() for p in r[3:]))


@view
def element_rules(d: Spark) -> str:
    """(rule_tag, t, c, cut_open, cut_close): the rules; for Spark the patterns are numbers of cuts()."""
    number = {p: str(i) for i, p in enumerate(cuts())}
    cut = (lambda p: f"'{p}'") if d.name == "duck" else number.get
    rows = ["(" + ", ".join([*(f"'{x}'" for x in r[:3]), *map(cut, r[3:])]) + ")" for r in rules()]
    return "select * from (values " + ", ".join(rows) + ") v(rule_tag, t, c, cut_open, cut_close)"


def clean_input_of(d: Spark, source: str) -> str:
    """(doc_id, pos, k, c, t, b, cut): tokens as the fold takes them; b is a text, escaped, or the attributes to write, in one order."""
    quoted = lambda s: f"replace(replace(replace(replace({s}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    attr = lambda name, value, when: f"case when {when} then ' {name}=\"' || {quoted(value)} || '\"' else '' end"
    span = lambda name: attr(name, name, f"t in ('td', 'th') and {d.like(f"coalesce({name}, '')", '^([2-9]|[1-9][0-9]{1,2}|1000)$')}")
    clean_href, verdict = link_verdict(d, "href")
    body = " || ".join([
        attr("src", "src", "t = 'img'"), attr("href", clean_href, "t = 'a'"), "case when t = 'img' then ' alt=\"' || " + quoted("coalesce(alt, '')") + " || '\"' else '' end",
        attr("lang", "lang", f"c not in ('inline', 'img') and {is_lang(d, "coalesce(lang, '')")}"), attr("scope", "scope", "t = 'th' and scope in ('row', 'col', 'rowgroup', 'colgroup')"), span("colspan"), span("rowspan"),
        attr("role", "role", "t = 'img' and role = 'presentation'"), "case when t = 'img' and (alt is null or needs = '1') then ' data-needs-alt=\"1\"' else '' end", attr("data-alt-source", "alt_source", "t = 'img' and trim(coalesce(alt_source, '')) <> ''"),
    ])
    names = {"src": "src", "href": "href", "alt": "alt", "lang": "lang", "scope": "scope", "colspan": "colspan", "rowspan": "rowspan", "role": "role", "needs": "data-needs-alt", "alt_source": "data-alt-source"}
    values = ", ".join(f"min(case when name = '{n}' then value end) {c}" for c, n in names.items())
    refused = f"(t = 'a' and k <> 'close' and not coalesce({verdict} = 'kept', false)) or (t = 'img' and not {d.like("coalesce(src, '')", PICTURE)})"
    text = f"replace(replace(replace({decoded('u.tok')}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    return f"""select doc_id, pos, k, case when k = 'text' and {d.sub('text', SPACE)} = '' then 'blank' else c end c, t, case when k = 'text' then text when k = 'close' then '' else {body} end b, case when k = 'close' then cut_close else cut_open end cut from (
        select u.doc_id, u.pos, u.kind k, r.c, r.t, r.cut_open, r.cut_close, case when u.kind = 'text' then {text} end text, {', '.join(names)} from {source}_undropped u join element_rules r on r.rule_tag = u.tag
        left join (select doc_id a_doc, pos a_pos, {values} from {source}_attributes group by doc_id, pos) a on a.a_doc = u.doc_id and a.a_pos = u.pos) m
      where not ({refused})"""


def _step(d: Spark, stack: str, todo: str, gap: str, x: str) -> list[tuple[str, str]]:
    """Names and expressions, each of which may use those before it: what a token (``x`` goes before its columns) makes of the state."""
    duck = d.name == "duck"
    size, arr = ("len", lambda s: f"[{s}]") if duck else ("size", lambda s: f"array({s})")
    first = (lambda a, n: f"{a}[1:{n}]") if duck else (lambda a, n: f"slice({a}, 1, {n})")
    plus = "list_concat" if duck else "concat"
    group = "\\1" if duck else "$1"
    sub = lambda s, p, new: f"regexp_replace({s}, {p}, {new})"
    solid = f"({x}c = 'text' or ({x}c = 'blank' and in_pre))"
    flow = f"({solid} or ({x}c = 'inline' and {x}k = 'open') or {x}c = 'img')"
    closed = lambda seg: (
        f"array_to_string(list_transform(list_reverse(list_filter(string_split({seg}, ' '), lambda y: y[1] in ('+', '.'))), lambda y: '</' || y[2:] || '>'), '')" if duck
        else f"array_join(transform(reverse(filter(split({seg}, ' '), y -> substr(y, 1, 1) in ('+', '.'))), y -> '</' || substr(y, 2) || '>'), '')")
    put = f"case when {x}k = 'close' and {x}c not in ('inline', 'box', 'skip') then '{group}' else '' end"
    raw = f"case when {d.like(stack, ' -pre')} then {d.sub(f'{x}b', r'^\n')} else {x}b end"
    inside = f"case when in_pre then {raw} else {d.sub(f'{x}b', f'^{SPACE}+|{SPACE}+$')} end"
    edge = lambda p: d.extract(f"{x}b", p, 0)
    syn = f"""case when {flow} and ctx in ('ul', 'ol') then 'li' when {flow} and ctx in ('', 'blockquote') then 'p'
      when {x}k <> 'close' and {x}c in ('block', 'pre', 'hr', 'list') and ctx in ('ul', 'ol') and {x}c <> 'list' then 'li' when {x}k = 'open' and {x}c = 'list' and ctx in ('ul', 'ol') then 'li'
      when {x}k = 'open' and {x}c = 'li' and ctx not in ('ul', 'ol') then 'ul' when {x}k = 'open' and {x}c = 'cell' and ctx = 'table' then 'tbody tr' when {x}k = 'open' and {x}c = 'cell' and ctx in ('thead', 'tbody', 'tfoot') then 'tr'
      when {x}k = 'open' and {x}c = 'row' and ctx = 'table' then 'tbody' else '' end"""
    pushed = f"{x}k = 'open' and {x}c in ('inline', 'block', 'pre', 'list', 'li', 'cell', 'row', 'section')"
    shown = f"({solid} or ({x}k <> 'close' and {x}c in ('img', 'hr', 'cell')))"
    new_path = f"keep || case when syn = '' then '' else ' -' || replace(syn, ' ', ' -') end || case when {pushed} then ' -' || {x}t else '' end"
    new_tags = f"{plus}({plus}({first(todo, f'{size}({todo}) - waiting')}, case when syn = '' then {arr('')} when syn = 'tbody tr' then {arr("'<tbody>', '<tr>'")} else {arr("'<' || syn || '>'")} end), case when {pushed} then {arr(f"'<' || {x}t || {x}b || '>'")} else {arr('')} end)"
    if duck:
        new_tags = new_tags.replace("[]", "cast([] as varchar[])")
    else:
        new_tags = new_tags.replace("array()", "cast(array() as array<string>)")
    joined = "array_to_string(tags, '')" if duck else "array_join(tags, '')"
    none = "cast([] as varchar[])" if duck else "cast(array() as array<string>)"
    if duck:
        kept = sub(stack, f"case when {x}c in ('text', 'blank') and (in_pre or {x}c = 'blank') then ' !$' else {x}cut end", put)
    else:
        each = " ".join(f"when {i} then {sub(stack, d.text(p), put)}" for i, p in enumerate(cuts()) if p != NOTHING)
        kept = f"case when {x}c = 'blank' or ({x}c = 'text' and in_pre) then {stack} else case {x}cut {each} else {stack} end end"
    done = lambda s: f"case when {x}k = 'close' and {x}c = 'li' then {sub(sub(s, "' [+]li$'", "' .li'"), "' -li$'", "' ,li'")} else {s} end"
    body = f"case when {solid} then {inside} when {x}c = 'img' then '<img' || {x}b || '>' when {x}c = 'hr' and {x}k <> 'close' then '<hr>' else '' end"
    return [
        ("in_pre", d.like(stack, " [^ ]pre( |$)")),
        ("keep", kept),
        ("seg", f"substr({stack}, length(keep) + 1)"),
        ("waiting", "cast(length(seg) - length(replace(replace(seg, '-', ''), ',', '')) as int)"),
        ("ctx", "regexp_extract(keep, '([a-z0-9]+)$', 1)"),
        ("syn", syn),
        ("tags", new_tags),
        ("path", new_path),
        ("lead", f"case when {x}c = 'text' and not in_pre and {gap} is not null then {edge(f'^{SPACE}+')} else '' end"),
        ("piece", f"{closed('seg')} || case when {shown} then case when {flow} then coalesce({gap}, '') || lead else '' end || {joined} || {body} else '' end"),
        ("new_stack", done(f"case when {shown} then translate(path, '-,', '+.') else path end")),
        ("new_todo", f"case when {shown} then {none} else tags end"),
        ("new_gap", f"""case when in_pre and {x}k = 'text' then '' when {x}c = 'text' then {edge(f'{SPACE}+$')} when {x}c = 'img' then '' when {x}c = 'blank' then case when {gap} is not null then {gap} || {x}b end
          when {x}c = 'br' then case when {gap} is not null then {gap} || '<br>' end when {x}c = 'inline' then {gap} end"""),
    ]


def cleaned_of(d: Spark, source: str) -> str:
    """(doc_id, html): the pages of a source, put together again."""
    if d.name == "duck":
        steps = _step(d, "stack", "todo", "gap", "")
        inner = "select s.doc_id, s.n, s.stack, s.todo, s.gap, x.k, x.c, x.t, x.b, x.cut from {self} s join {source}_numbered x on x.doc_id = s.doc_id and x.n = s.n + 1".format(self=f"{source}_states", source=source)
        for name, expr in steps:
            inner = f"select *, {expr} {name} from ({inner}) q_{name}"
        return inner
    fields = "named_struct('stack', {0}, 'todo', {1}, 'gap', {2}, 'out', {3})"
    body = fields.format("new_stack", "new_todo", "new_gap", "array_append(a.out, piece)")
    for name, expr in reversed(_step(d, "a.stack", "a.todo", "a.gap", "x.")):
        body = f"element_at(transform(array({expr}), {name} -> {body}), 1)"
    empty = "cast(array() as array<string>)"
    start = fields.format("''", empty, "cast(null as string)", empty)
    inner = f"aggregate(slice(toks, 1 + {SLICE} * i, {SLICE}), {fields.format('o.stack', 'o.todo', 'o.gap', empty)}, (a, x) -> {body})"
    outer = f"aggregate(sequence(0, cast((size(toks) - 1) / {SLICE} as int)), {start}, (o, i) -> element_at(transform(array({inner}), r -> {fields.format('r.stack', 'r.todo', 'r.gap', "array_append(o.out, array_join(r.out, ''))")}), 1))"
    rest = f"array_join(transform(reverse(filter(split(f.stack, ' '), y -> substr(y, 1, 1) in ('+', '.'))), y -> '</' || substr(y, 2) || '>'), '')"
    return f"""select doc_id, array_join(f.out, '') || {rest} html from (select doc_id, {outer} f from (
      select doc_id, array_sort(collect_list(named_struct('pos', pos, 'k', k, 'c', c, 't', t, 'b', b, 'cut', cut))) toks from {source}_input group by doc_id) t) s"""


def register(source: str, table: str, html: str, key: str) -> None:
    """The views that clean the pages of a table: tokens, those outside dropped elements, attributes, and the cleaned pages."""
    def named(name, f):
        f.__name__ = name
        return view(f)

    named(f"{source}_tokens", lambda d: tokens_of(d, f"(select {key} doc_id, {html} html from {table})"))
    named(f"{source}_undropped", lambda d: undropped_of(d, f"{source}_tokens"))
    named(f"{source}_attributes", lambda d: attributes_of(d, f"{source}_tokens"))
    named(f"{source}_input", lambda d: clean_input_of(d, source))
    named(f"{source}_numbered", lambda d: f"select *, row_number() over (partition by doc_id order by pos) n from {source}_input")
    named(f"{source}_states", lambda d: f"""select doc_id, cast(0 as bigint) n, '' stack, cast([] as varchar[]) todo, cast(null as varchar) gap, '' piece from (select distinct doc_id from {source}_input) b
      union all select doc_id, n + 1, new_stack, new_todo, new_gap, piece from ({cleaned_of(d, source)}) z""")

    def cleaned(d: Spark) -> str:
        if d.name != "duck":
            return cleaned_of(d, source)
        closers = "array_to_string(list_transform(list_reverse(list_filter(string_split(stack, ' '), lambda y: y[1] in ('+', '.'))), lambda y: '</' || y[2:] || '>'), '')"
        return f"select doc_id, string_agg(piece, '' order by n) || max_by({closers}, n) html from {source}_states group by doc_id"

    named(f"{source}_clean", cleaned)


register("page", "pages", "html", "page_id")


@operator
def clean_corpus(d: Spark) -> str:
    """Pages put together again: known elements alone, each closed, in a tidy order, with the attributes that count."""
    return "select doc_id, html from page_clean"


@view
def clean_tokens(d: Spark) -> str:
    """The tokens of the cleaned pages: every element is closed, and every list holds items alone."""
    return tokens_of(d, "page_clean")


@operator
def list_repair(d: Spark) -> str:
    """Items of the repaired lists with their level and own text: what stood loose in a list is an item, a list in a list belongs to the item before."""
    return f"""
      select doc_id, cast(list_no as bigint) list, cast(item as bigint) item, cast(level as bigint) level, text from (
        select doc_id, item, max(level) level, max(list_no) list_no, {squeeze(d, d.join(decoded('tok'), '', 'pos', "kind = 'text'"))} text
        from (select *, max(case when tag = 'li' and kind = 'open' then pos end) over w item,
                     max(case when (tag = 'li' and kind = 'close') or tag in ('ul', 'ol') then pos end) over w ended,
                     sum(case when tag in ('ul', 'ol') and kind = 'open' then 1 when tag in ('ul', 'ol') and kind = 'close' then -1 else 0 end) over w level,
                     sum(case when tag in ('ul', 'ol') and kind = 'open' then 1 else 0 end) over w list_no
              from clean_tokens window w as (partition by doc_id order by pos rows between unbounded preceding and current row)) t
        where item > coalesce(ended, -1) group by doc_id, item) u
      where text <> '' and level > 0"""
