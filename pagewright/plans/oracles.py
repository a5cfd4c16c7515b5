"""DuckDB SQL with the rows of the general operators, over whole tables: the plain way to the same result."""

SNAPSHOT_DIFF = r"""with run as (select run_id, job_id, row_number() over (partition by job_id order by started_at nulls first, run_id) as seq from crawl_run where status = 'done'),
 rec as (select e.record_id, r.job_id, r.seq, e.template_id, e.record_index, e.payload, e.extracted_at, regexp_replace(e.page_url, '#.*$', '') as u from extracted_record e join run r on e.run_id = r.run_id),
 url as (select *, regexp_replace(lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)', 1)), ':443$', '') as head, regexp_replace(u, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*', '') as tail from rec),
 can as (select *, regexp_replace(head || case when contains(tail, '?') then regexp_replace(regexp_replace(tail, '([?&])(?:(?:utm_[^&=]*|gclid)(?:=[^&]*)?(?:&|$))+', '\1', 'g'), '[?&]+$', '') else tail end, '/+$', '') as page_url from url),
 latest as (select * from can qualify row_number() over (partition by job_id, seq, page_url, template_id, record_index order by extracted_at desc nulls last, record_id desc) = 1),
 field as (select l.job_id, l.seq, l.page_url, l.template_id, l.record_index, string_agg(j.key || chr(1) || case when j.type in ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT') then 'n' || cast(cast(j.value as varchar) as double) else left(j.type, 1) || cast(j.value as varchar) end, chr(2) order by j.key) as fields
   from latest l, json_each(l.payload) j where j.type <> 'NULL' group by 1, 2, 3, 4, 5),
 snap as (select l.job_id, l.seq, l.page_url, l.template_id, l.record_index, coalesce(f.fields, '') as fields from latest l left join field f using (job_id, seq, page_url, template_id, record_index)),
 diff as (select coalesce(b.job_id, a.job_id) as job_id, coalesce(b.seq, a.seq + 1) as seq, coalesce(b.page_url, a.page_url) as page_url, coalesce(b.template_id, a.template_id) as template_id, coalesce(b.record_index, a.record_index) as record_index,
   case when a.fields is null then 'added' when b.fields is null then 'removed' when a.fields <> b.fields then 'changed' end as change_kind
   from snap a full join snap b on a.job_id = b.job_id and a.seq + 1 = b.seq and a.page_url = b.page_url and a.template_id = b.template_id and a.record_index = b.record_index)
select d.job_id, r.run_id, d.page_url, d.template_id, d.record_index, d.change_kind from diff d join run r on d.job_id = r.job_id and d.seq = r.seq where d.change_kind is not null and d.seq > 1"""

SCHEMA_DRIFT = r"""with v as (select job_id, version, max(payload) as payload from strategy_config group by 1, 2), o as (select *, lag(version) over (partition by job_id order by version) as before from v),
 f as (select o.job_id, o.version, json_extract_string(t.value, '$.id') as template_id, coalesce(json_extract_string(x.value, '$.name'), x.key) as name, cast(coalesce(json_extract(x.value, '$.locators'), json_extract(x.value, '$.selectors')) as varchar) as loc,
   coalesce(json_extract_string(x.value, '$.type'), json_extract_string(x.value, '$.dtype')) as type from o, json_each(coalesce(json_extract(o.payload, '$.pageTemplates'), json_extract(o.payload, '$.templates'))) t, json_each(json_extract(t.value, '$.fields')) x),
 now as (select f.*, o.before from f join o using (job_id, version) where o.before is not null), was as (select f.job_id, o.version, f.template_id, f.name, f.loc, f.type from f join o on f.job_id = o.job_id and f.version = o.before),
 fresh as (select * from now n where not exists (select 1 from was w where w.job_id = n.job_id and w.version = n.version and w.template_id = n.template_id and w.name = n.name)),
 gone as (select * from was w where not exists (select 1 from now n where w.job_id = n.job_id and w.version = n.version and w.template_id = n.template_id and w.name = n.name)),
 config as (select n.job_id, n.version, n.template_id, n.name, case when exists (select 1 from gone g where g.job_id = n.job_id and g.version = n.version and g.template_id = n.template_id and g.loc = n.loc) then 'renamed' else 'added' end as kind from fresh n
   union all select g.job_id, g.version, g.template_id, g.name, 'removed' from gone g where not exists (select 1 from fresh n where g.job_id = n.job_id and g.version = n.version and g.template_id = n.template_id and g.loc = n.loc)
   union all select n.job_id, n.version, n.template_id, n.name, 'retyped' from now n join was w on w.job_id = n.job_id and w.version = n.version and w.template_id = n.template_id and w.name = n.name where w.type is distinct from n.type),
 run as (select run_id, job_id, row_number() over (partition by job_id order by started_at nulls first, run_id) as seq from crawl_run where status = 'done'),
 k as (select r.job_id, r.seq, e.template_id, j.key, string_agg(distinct case when j.type = 'VARCHAR' then 's' when j.type = 'BOOLEAN' then 'b' when j.type in ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT') then 'n' end, '' order by case when j.type = 'VARCHAR' then 's' when j.type = 'BOOLEAN' then 'b' when j.type in ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT', 'UHUGEINT') then 'n' end) as types
   from extracted_record e join run r on e.run_id = r.run_id, json_each(e.payload) j group by 1, 2, 3, 4),
 p as (select distinct r.job_id, r.seq, e.template_id from extracted_record e join run r on e.run_id = r.run_id), both_ as (select b.job_id, b.seq, b.template_id from p a join p b on a.job_id = b.job_id and a.seq + 1 = b.seq and a.template_id = b.template_id),
 d as (select x.job_id, x.seq, x.template_id, x.key, max(case when side = 'b' then coalesce(types, '') end) as now, max(case when side = 'a' then coalesce(types, '') end) as was from
   (select *, 'b' as side from k union all select job_id, seq + 1, template_id, key, types, 'a' from k) x join both_ using (job_id, seq, template_id) group by 1, 2, 3, 4)
select 'config' as layer, job_id, cast(version as varchar) as file_id, template_id, name as field_name, kind as change_kind from config
union all select 'record', d.job_id, r.run_id, d.template_id, d.key, case when was is null then 'added' when now is null then 'removed' else 'retyped' end from d join run r on d.job_id = r.job_id and d.seq = r.seq
  where was is null or now is null or (was <> now and was <> '' and now <> '')"""
