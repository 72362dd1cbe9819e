-- Derived views over the given tables, the same text for Spark and for DuckDB.
-- fx_li: numbered parts per "document" = order
create view fx_li as
select l_orderkey doc_id,
       cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate) as int) ord,
       l_partkey pk, l_suppkey sk, cast(l_quantity as int) qty, l_extendedprice price, l_returnflag rf,
       p_name name, p_size psize
from lineitem join part on p_partkey = l_partkey;
-- fx_lp: numbered parts per "report document" = part (about 30 rows each, so trees are deep enough)
create view fx_lp as
select l_partkey doc_id,
       cast(row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice) as int) ord,
       l_orderkey ok, l_suppkey sk, cast(l_quantity as int) qty, p_name name
from lineitem join part on p_partkey = l_partkey;
create view fx_headings as
select doc_id, ord ordinal, cast(1 + pk % 4 as int) level,
       case when sk % 10 = 0 then '   ' else name end text from fx_li;
create view fx_pictures as
select doc_id, cast(1 + ord % 2 as int) page, ord ordinal, pk % 5 xref, sk % 3 <> 0 in_tagged,
       pk % 7 <> 0 has_alt,
       case when pk % 7 = 0 then null when pk % 3 = 0 then '' when pk % 4 = 0 then 'Image of a ' || name else name end alt,
       sk % 5 = 0 needs_alt,
       case sk % 4 when 0 then 'ai:openai' when 1 then 'pdf' else '' end alt_source,
       case when pk % 9 = 0 then 'presentation' else '' end role,
       case pk % 6 when 0 then 'data:image/png;base64,AA' when 1 then 'https://x.example/a.png'
            when 2 then '//host/share/a.png' when 3 then 'javascript:x' when 4 then 'data:image/svg+xml;base64,AA'
            else 'pics/a.png' end src,
       psize * 20 w_px, psize * 3 h_px,
       72.0 + qty * 4 x0, 60.0 * ord y0, 72.0 + qty * 4 + psize * 8 x1, 60.0 * ord + psize * 5 y1,
       price / 20 kb, qty % 11 <> 0 readable
from fx_li;
create view fx_links as
select doc_id, ord ordinal,
       case pk % 6 when 0 then ' ' when 1 then 'Click here.' when 2 then 'https://x.example/' || cast(pk as string)
            when 3 then 'read more' else name end text,
       case sk % 7 when 0 then 'javascript:alert(1)' when 1 then 'mailto:a@x.example?subject=a b' when 2 then 'tel:5'
            when 3 then 'ftp://x.example/' when 4 then '/rel' when 5 then null else 'https://x.example/' || cast(pk as string) end href
from fx_li;
create view fx_tables as
select doc_id, ord ordinal, cast(pk % 3 as int) n_th, sk % 2 = 0 has_caption from fx_li;
create view fx_cells as
select doc_id, ord tbl, r, c,
       case when r = 0 and pk % 2 = 0 then 'th' when c = 0 and sk % 2 = 0 then 'th' else 'td' end tag,
       case when (pk + r + c) % 11 = 0 then 'row' end scope,
       case when (pk + c) % 9 = 0 then '2' when (pk + c) % 9 = 1 then 'x' else '1' end colspan,
       name || ' ' || cast(r as string) || cast(c as string) text
from fx_li cross join (select 0 r union all select 1 union all select 2) a
           cross join (select 0 c union all select 1 union all select 2) b;
-- report documents: one row per part
create view fx_docs as
select p_partkey doc_id, p_partkey % 31 <> 0 readable, p_partkey % 5 <> 0 marked,
       case p_partkey % 4 when 0 then 'en-US' when 1 then '' when 2 then 'english language' else 'es' end lang,
       p_partkey % 3 <> 0 display_title,
       case when p_partkey % 6 = 0 then '' else p_name end xmp_title,
       case when p_partkey % 12 = 0 then '' else p_name end info_title,
       case when p_partkey % 2 = 0 then '1' else '' end part_id,
       p_partkey % 7 <> 0 outline, p_partkey % 17 = 0 suspects, p_partkey % 19 = 0 xfa,
       p_partkey % 13 = 0 encrypted, p_partkey % 26 = 0 allow_access, p_partkey % 39 = 0 allow_extract,
       p_type producer, 'file-' || cast(p_partkey as string) || '.pdf' file_name
from part;
create view fx_elems as
select doc_id, ord elem_id, case when ord = 1 then null else cast(floor(ord / 2) as int) end parent_id,
       case when ord = 1 then '/Document' else
       case (ok + sk) % 14 when 0 then '/H1' when 1 then '/H2' when 2 then '/H3' when 3 then '/P' when 4 then '/Figure'
            when 5 then '/L' when 6 then '/LI' when 7 then '/LBody' when 8 then '/Table' when 9 then '/TH'
            when 10 then '/Strong' when 11 then '/Link' when 12 then '/Em' else '/Aside' end end kind,
       case when sk % 3 = 0 then null else cast(1 + ok % 3 as int) end page,
       case when ok % 4 = 0 then name else '' end alt, case when ok % 8 = 1 then name else '' end actual_text
from fx_lp;
create view fx_rolemap as
select p_partkey doc_id, '/Strong' from_kind, '/Em' to_kind from part
union all
select p_partkey, '/Em', case when p_partkey % 3 = 0 then '/Strong' else '/Span' end from part;
create view fx_content as
select doc_id, cast(1 + ok % 3 as int) page, ord mcid, ord elem_id, name || ' ' || cast(ord as string) text from fx_lp;
create view fx_fonts as
select doc_id, ord font_id, case when ok % 2 = 0 then 'ABCDEF+' else '' end || name font_name,
       case ok % 3 when 0 then '/Type3' when 1 then '/Type0' else '/TrueType' end subtype,
       sk % 6 <> 0 has_file, sk % 4 <> 0 has_tounicode, case when ok % 5 = 0 then '/WinAnsiEncoding' end encoding
from fx_lp;
create view fx_annots as
select doc_id, cast(1 + ok % 3 as int) page, ord annot_id,
       case ok % 4 when 0 then '/Link' when 1 then '/Widget' when 2 then '/Text' else '/Popup' end subtype,
       sk % 5 <> 0 has_struct_parent, case when sk % 3 = 0 then '' else name end contents,
       case when ord <= 2 then null else cast(floor(ord / 3) as int) end parent_id,
       case when ord % 4 = 0 then name else '' end tip
from fx_lp;
create view fx_pdf_pages as
select doc_id, ord page, 612.0 width, 792.0 height,
       case when ok % 5 = 0 then '' when ok % 5 = 1 then '��' || name else name end text,
       case when ok % 5 = 0 then 0 else length(name) end chars, case when sk % 9 = 0 then 3 else 0 end untagged,
       cast(sk % 2 as int) images, case when sk % 8 = 0 then 2 else 0 end unmarked,
       case when sk % 4 = 0 then '' else '/S' end tabs
from fx_lp;
-- positioned lines: 12 per page, first and last fall in the margin tenth of a 792 pt page
create view fx_lines as
select doc_id, source, cast(floor(i / 12) as int) page, cast(i % 12 as int) line, cast(floor((i % 12) / 2) as int) block,
       case when i % 12 = 0 then 'Page ' || cast(floor(i / 12) + 1 as int) || ' of ' || source
            when i % 7 = 2 then '- ' || text when i % 11 = 3 then cast(i as string) || '. ' || text
            when i % 13 = 4 then text || '-' else text end text,
       case when i % 2 = 0 then 72.0 else 330.0 end x0, 30.0 + 62 * (i % 12) y0,
       case when i % 2 = 0 then 280.0 else 540.0 end x1, 42.0 + 62 * (i % 12) y1,
       case when length(text) < 25 then 18.2 when length(text) < 40 then 14.3 else 11.1 end size,
       i % 5 = 0 bold
from fx_doc_lines;
create view fx_spans as
select doc_id, page, block, line, 0 span, substr(text, 1, 10) text, size, bold, line % 4 = 0 italic from fx_lines
union all
select doc_id, page, block, line, 1, substr(text, 11), size, bold, line % 3 = 0 from fx_lines where length(text) > 10;
-- forms: labels and shapes on one page per order
create view fx_form_lines as
select doc_id, 1 page, ord line,
       case pk % 4 when 0 then name || ':' when 1 then name || ': ______' when 2 then '[ ] ' || name else name end text,
       72.0 x0, 50.0 + 40 * ord y0, 72.0 + 4 * length(name) x1, 62.0 + 40 * ord y1 from fx_li;
create view fx_shapes as
select doc_id, 1 page, ord shape_id,
       case sk % 3 when 0 then 'rule' when 1 then 'box' else 'upright' end kind,
       100.0 + qty x0, case sk % 3 when 2 then 40.0 else 50.0 + 40 * ord + psize % 20 end y0,
       case sk % 3 when 2 then 100.0 + qty else 100.0 + qty + psize * 6 end x1,
       case sk % 3 when 0 then 50.0 + 40 * ord + psize % 20 when 2 then 420.0 else 50.0 + 40 * ord + psize % 20 + 14 + pk % 30 end y1
from fx_li;
create view fx_proposals as
select doc_id, 1 page, ord pid, case pk % 4 when 0 then '' else name end label,
       case sk % 4 when 0 then 0.9 when 1 then 0.8 when 2 then 0.62 else 0.5 end confidence,
       case sk % 4 when 3 then 'colon' when 2 then 'line' when 1 then 'box' else 'underscores' end source,
       100.0 + qty x0, 50.0 + 5 * ord y0, 160.0 + qty + psize x1, 64.0 + 5 * ord y1 from fx_li;
create view fx_fields as
select doc_id, ord field_id, 'f' || cast(ord % 3 as string) name,
       case pk % 9 when 0 then 'text' when 1 then 'multiline text' when 2 then 'checkbox'
            when 4 then 'choice' when 5 then 'signature' when 6 then 'button' else 'radio' end kind,
       cast(qty % 9 as int) max_len, sk % 10 = 0 read_only, 'Red|Blue|' || name choices,
       cast(1 + ord % 2 as int) page, 105.0 + qty + 200 * (pk % 3) x0, 50.0 + 5 * ord y0, 150.0 + qty + 200 * (pk % 3) x1, 62.0 + 5 * ord y1,
       case when sk % 2 = 0 then name else '' end value, sk % 3 = 0 multi, sk % 7 = 0 editable
from fx_li;
create view fx_answers as
select doc_id, ord + cast(case when pk % 13 = 0 then 50 else 0 end as int) field_id,
       case sk % 6 when 0 then ' blue ' when 1 then name when 2 then 'Green' when 3 then 'red|Blue' when 4 then 'off' else '' end ||
       case when pk % 11 = 0 then chr(10) || ' line' else '' end answer from fx_li;
create view fx_form_pages as
select doc_id, page, 612.0 + 30 * (page % 3) width, 792.0 + 50 * (doc_id % 2) height from (select doc_id, ord page from fx_li union select doc_id, 1 from fx_li union select doc_id, 2 from fx_li) p;
create view fx_replies as
select doc_id, ord page, case when pk % 17 = 0 then 'No list here' else 'The blanks: ' end || case when pk % 19 = 0 then '[{"label":"cut off' else '[' ||
       '{"label":"' || case when pk % 5 = 0 then '' else name end || '","rect":[' || cast(qty * 20 as string) || ',' || cast(psize * 10 as string) || ',' ||
       cast(qty * 20 + pk % 40 - 10 as string) || ',' || cast(psize * 10 + pk * 7 % 300 as string) || '],"kind":"' || case when sk % 2 = 0 then 'checkbox' else 'poem' end || '","confidence":' || cast(pk % 4 as string) || '},' ||
       case when pk % 7 = 0 then '"no box",{"label":"odd","rect":["x",1,2,3]},' else '' end || '{"kind":"date","rect":[100,50,300,70]},{"label":"  two   words ","rect":[10,700,90,' || cast(705 + qty as string) || '],"kind":"Signature"}] as asked' end reply from fx_li;
create view fx_unnamed_fields as
select doc_id, field_id, 1 page, x0 + 60 x0, 50 + 40 * field_id + case when field_id % 3 = 0 then 14 else 0 end y0, x1 + 60 x1, 62 + 40 * field_id + case when field_id % 3 = 0 then 14 else 0 end y1 from fx_fields;
create view fx_tick_shapes as
select doc_id, page, shape_id, x0 - 160 x0, x1 - 160 x1, y0 - 12 y0, y1 from fx_shapes where x1 - 160 < 72;
-- word-processor paragraphs and a style chain
create view fx_styles as
select doc_id, ord style_id, case when ord = 1 then null else ord - 1 end base_id,
       case when ord = 1 and sk % 2 = 0 then 2 end outline_lvl,
       case pk % 5 when 0 then 'title' when 1 then 'heading 2' when 2 then 'List Bullet 3' else 'Body' end style_name
from fx_li;
create view fx_snapshots as
select user_id source_id, event_id snapshot_id, ts saved_at, event_type title from events;
-- characters, words and rectangles for the geometry joins
create view fx_digits as select 0 n union all select 1 union all select 2 union all select 3 union all select 4
union all select 5 union all select 6 union all select 7 union all select 8 union all select 9;
create view fx_words as
select doc_id, page, line * 2 word_id, substr(text, 1, 5) text, x0, y0, x0 + 20 x1, y1 from fx_form_lines
union all
select doc_id, page, line * 2 + 1, substr(text, 6), x0 + 20, y0, x1, y1 from fx_form_lines where length(text) > 5;
create view fx_link_rects as
select doc_id, page, line link_id, 'https://x.example/' || cast(line as string) uri, x0 - 5 x0, y0 - 2 y0,
       x0 + 60.0 + 40 * (line % 3) x1, y1 + 2 y1 from fx_lines where (doc_id + line) % 3 = 0;
create view fx_table_boxes as
select doc_id, page, shape_id tbl, x0 - 60 x0, y0 - 20 y0, x1 x1, y1 + 20 y1 from fx_shapes where kind = 'box';
create view fx_marks as
select doc_id, page, xref, ordinal seq, in_tagged from fx_pictures where ordinal % 6 <> 5;
create view fx_figure_alts as
select doc_id, page, ordinal seq, coalesce(alt, 'none') alt from fx_pictures where in_tagged or ordinal % 4 = 0;
create view fx_ops as
select doc_id, 1 page, ord seq, case ok % 8 when 0 then 'BDC' when 1 then 'EMC' when 2 then 'm' when 3 then 'f'
       when 4 then 're' when 5 then 'S' when 6 then 'Do' else 'sh' end op from fx_lp;
create view fx_list_items as
select doc_id, ord item_id, cast(sk % 4 as int) level, case when pk % 3 = 0 then 'ol' else 'ul' end tag, name text from fx_li;
create view fx_doc_paragraphs as
select doc_id, ord para, cast(1 + pk % 6 as int) style_id, nullif(cast(pk % 5 as int), 4) num_id, cast(sk % 3 as int) ilvl, name text,
       case when pk % 11 = 0 then cast(sk % 9 as int) end outline_lvl from fx_li;
create view fx_nums as
select doc_id, n num_id, (n + doc_id) % 3 abstract_id from (select distinct doc_id from fx_doc_paragraphs) p cross join fx_digits d where n between 1 and 3;
create view fx_num_overrides as
select doc_id, num_id, b.n ilvl, c.n seq, case (doc_id + b.n + c.n) % 4 when 0 then 'bullet' when 1 then 'upperRoman' when 2 then 'none' end fmt
from fx_nums m cross join fx_digits b cross join fx_digits c where num_id = 2 and b.n < 2 and c.n < 2;
create view fx_abstract_nums as
select doc_id, a.n abstract_id, b.n ilvl, case (doc_id + a.n + b.n) % 4 when 0 then 'bullet' when 1 then 'decimal' when 2 then 'none' end fmt
from (select distinct doc_id from fx_doc_paragraphs) p cross join fx_digits a cross join fx_digits b where a.n < 3 and b.n < 3;
create view fx_doc_features as
select p_partkey doc_id, p_size % 2 = 0 tracked, p_size % 3 = 0 textboxes, p_size % 5 = 0 equations, p_size % 7 = 0 toc,
       p_size % 4 = 0 notes, p_size % 6 = 0 comments, p_size % 11 = 0 headers from part;
create view fx_declared as select doc_id, cast(max(page) + doc_id % 2 as int) expected from fx_pdf_pages group by doc_id;
create view fx_meta as
select p_partkey doc_id, case p_size % 4 when 0 then 'A4' when 1 then 'letter' when 2 then 'A3' else '' end page_size,
       case when p_size % 6 = 0 then 'wide' else cast(p_size % 5 as string) end margin_inches, cast(p_size as string) font_points,
       case when p_size % 3 = 0 then 'Arial; x' else 'Georgia, serif' end font_family,
       case p_size % 3 when 0 then 'en-US' when 1 then '' else 'not a code' end lang from part;
-- before / after for the issue diff
create view fx_headings_prev as select * from fx_headings where ordinal % 5 <> 4;
create view fx_pictures_prev as select doc_id, ordinal, alt, has_alt, not needs_alt needs_alt, alt_source from fx_pictures where ordinal % 5 <> 3;
create view fx_links_prev as select doc_id, ordinal, case when ordinal % 4 = 1 then 'more' else text end text from fx_links where ordinal % 6 <> 5;
create view fx_tables_prev as select doc_id, ordinal, cast(ordinal % 2 as int) * n_th n_th, has_caption from fx_tables;
-- texts and pages with what the given ones lack, for rules over a whole table
create view fx_symbol_texts as select doc_id, case when doc_id % 8 = 0 then '�' || substr(text, 3) else text end text from documents;
create view fx_control_texts as select doc_id, case when doc_id % 8 = 0 then chr(7) || text else text end text from documents;
create view fx_rtl_texts as select doc_id, case when doc_id % 9 = 0 then text || ' אב ع' else text end text from documents;
create view fx_page_meta as
select doc_id, case when doc_id % 6 = 0 then ' ' else title end title, case when doc_id % 5 = 0 then '' else lang end lang from page_meta;
create view fx_page_headings as select doc_id, ordinal, level, text from headings where doc_id % 3 <> 0;
create view fx_recognised as
select distinct doc_id, page from fx_lines where page % 2 = 1 union select distinct doc_id, page from fx_pictures where doc_id % 2 = 0;
-- sizes of pages, shapes beside lines, words of lines, captions
create view fx_line_pages as
select doc_id, page, 612.0 + 40 * (doc_id % 2) width, case when doc_id % 5 = 0 then 595.0 else 792.0 end height from (select distinct doc_id, page from fx_lines) p;
create view fx_bullet_shapes as
select doc_id, page, x0 - 40 - psize % 10 x0, x0 - 40 x1, y0, y0 + 1 + qty % 9 y1 from (select s.doc_id, s.page, s.x0, s.y0, l.psize, l.qty from fx_shapes s join fx_li l on l.doc_id = s.doc_id and l.ord = s.shape_id where s.kind = 'box') b;
create view fx_line_words as
select doc_id, page, line * 2 word_id, substr(text, 1, 5) text, x0, y0, x0 + 20 x1, y1 from fx_lines
union all select doc_id, page, line * 2 + 1, substr(text, 6, 20), x0 + 20, y0, x0 + 200, y1 from fx_lines where length(text) > 5;
create view fx_captions as select doc_id, ord ordinal, name caption from fx_li where ord % 3 = 0;
-- blocks before pictures, sources, formats of spans, shapes beside lines, what a file says of itself, numbers of styles
create view fx_blocks as
select doc_id, ordinal, case when ordinal % 3 = 1 then level end level, case when ordinal % 3 = 1 then text else repeat(text || ' ', 1 + 3 * level * level) end text from fx_headings where ordinal % 7 <> 5;
create view fx_sources as select distinct doc_id, 'source ' || cast(doc_id % 7 as string) source from fx_li;
create view fx_formatted_spans as
select s.doc_id, s.page, s.block, s.line, s.span, s.text, s.bold, s.italic, s.line % 5 = 0 and s.span = 1 mono, s.line % 6 = 1 superscript,
       l.x0 + 60 * s.span x0, l.x0 + 60 + 100 * s.span x1, l.y0, l.y1 from fx_spans s join fx_lines l on l.doc_id = s.doc_id and l.page = s.page and l.line = s.line;
create view fx_line_shapes as select doc_id, page, x0 - 10 - line x0, x0 - 6 - line % 3 x1, y0 + 4 y0, y0 + 8 y1 from fx_lines where (doc_id + line) % 4 = 0;
create view fx_doc_info as select p_partkey doc_id, case when p_size % 3 = 0 then ' ' || p_brand else '' end author, case when p_size % 4 = 0 then p_type end subject from part;
create view fx_style_nums as select doc_id, ord style_id, cast(1 + sk % 4 as int) num_id, case when sk % 2 = 0 then cast(pk % 3 as int) end ilvl from fx_li where pk % 3 = 0;
-- texts with blank lines and dashes, pages with figures and code, terms to look for
create view fx_plain_texts as
select a.doc_id, coalesce(a.text, '') || chr(10) || chr(10) || coalesce(b.text, '') text from documents a left join documents b on b.doc_id = a.doc_id + 1;
create view fx_dash_lines as select doc_id, i line_no, replace(text, ', ', ' — ') line from fx_doc_lines;
create view fx_figure_pages as
select doc_id, '<p>before</p><figure><img src="a.png" alt="x">' || case when ord % 3 = 0 then 'loose <b>words</b>' else '' end || case when ord % 2 = 0 then '<figcaption>' || name || '</figcaption>' else '' end ||
       case when ord % 5 = 0 then '<img src="b.png"><figcaption>second</figcaption>' else '' end || '</figure><figure><figcaption>alone ' || name || '</figcaption></figure>' html from fx_li where ord <= 5 and ord = doc_id % 5 + 1;
create view fx_code_pages as
select doc_id, '<p>x</p><pre>' || chr(10) || replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(10) || chr(10) || '</pre><pre>one<br>two</pre>' html from documents;
create view fx_terms as
select 'the' term, false match_case union all select 'The', true union all select 'on', false union all select '. ', true union all select 'nowhere (at) all', false union all select '100%', false;
create view fx_replacements as
select 'the' find, 'das' repl, false match_case union all select 'on', 'upon', true union all select 'a.b', 'c', false;
