"""SQL twins of the registered queries, in the dialect of the checking database.

Views with the table names are given. Texts of the tables are Latin, so ``strip_accents``
plus ``ß`` covers the folding, and edit distances are taken on folded text.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_NOISE = (
    "hd|hq|uhd|4k|8k|2160p|1440p|1080p?|720p|audio|video|lyric|lyrics|official|oficial|officiel|mv|live|vivo"
    "|directo|remaster|remastered|remix|rmx|stereo|mono|version|visualizer|visualiser|performance"
)


def norm(c: str) -> str:
    """F3 over Latin text."""
    fold = f"replace(strip_accents(lower({c})), 'ß', 'ss')"
    noise = f"regexp_replace({fold}, '\\b(?:{_NOISE})\\b', ' ', 'g')"
    words = f"regexp_replace({noise}, '[^\\p{{L}}\\p{{M}}\\p{{N}}]+', ' ', 'g')"
    return f"trim(regexp_replace({words}, ' (?:feat|ft|featuring|prod) .*$', ''))"


ORACLE["normalize_titles"] = f"""
with n as (select doc_id, {norm('text')} as key from documents)
select doc_id, md5(key) as key_md5, length(key) as key_chars from n"""

_TITLES = """
titles as (
  select p_partkey as title_id, p_brand as brand, p_name as name,
    p_brand || ' - ' || p_name || (case p_partkey % 6 when 0 then '' when 1 then ' (Official Video)' when 2 then ' [HD]'
      when 3 then ' (2011 - Remaster)' when 4 then ' ft. Someone Else' else ' (Live) [4K]' end) as raw_title
  from part)"""

ORACLE["clean_titles"] = f"""
with {_TITLES}
select title_id, trim(regexp_replace(regexp_replace(raw_title, '\\s*\\(official[^)]*\\)|\\s*\\[[^\\]]*\\b(?:hd|4k)\\b[^\\]]*\\]|\\s*\\([^)]*\\bremaster\\b[^)]*\\)|\\s*\\(live[^)]*\\)', '', 'gi'),
  '\\s*\\bft\\.?\\s+.+$', '', 'i')) as clean from titles"""

_CANDIDATES = f"""{_TITLES},
cands as (
  select title_id, 0 as prio, brand as artist, name as track from titles
  union all select title_id, 1, name, brand from titles
  union all select title_id, 2, '', name from titles
  union all select title_id, 3, '', brand from titles
  union all select title_id, 4, '', brand || ' - ' || name from titles)"""

ORACLE["candidates_dash"] = f"with {_CANDIDATES} select * from cands"

# Candidates by kind of title, in their order of trust; "first" and "second" are the words of a name.
ORACLE["titles_by_rule"] = """
with p as (select p_partkey as title_id, p_partkey % 8 as kind, p_brand as b, p_name as n, p_type as t, p_size % 2 = 0 as told,
    split_part(p_name, ' ', 1) as first, split_part(p_name, ' ', 2) as second from part),
c as (
  select title_id, unnest([
    {'prio': 0, 'artist': b || ', ' || t, 'track': n, 'album': ''}, {'prio': 1, 'artist': b, 'track': n, 'album': ''},
    {'prio': 2, 'artist': t, 'track': n, 'album': ''}, {'prio': 3, 'artist': '', 'track': n || ' • ' || b || ', ' || t, 'album': ''}]) as c from p where kind = 0
  union all select title_id, unnest([
    {'prio': 0, 'artist': b, 'track': n, 'album': ''}, {'prio': 1, 'artist': '', 'track': n, 'album': ''},
    {'prio': 2, 'artist': b, 'track': '"' || n || '"', 'album': ''}, {'prio': 3, 'artist': b || ' "' || first, 'track': second || '"', 'album': ''},
    {'prio': 4, 'artist': '', 'track': b || ' "' || n || '"', 'album': ''}]) from p where kind = 1
  union all select title_id, unnest([
    {'prio': 0, 'artist': b, 'track': n, 'album': ''}, {'prio': 1, 'artist': n, 'track': b, 'album': ''},
    {'prio': 2, 'artist': '', 'track': n, 'album': ''}, {'prio': 3, 'artist': '', 'track': b || ': ' || n, 'album': ''}]) from p where kind = 2
  union all select title_id, unnest([
    {'prio': 0, 'artist': n, 'track': b, 'album': ''}, {'prio': 1, 'artist': b, 'track': n, 'album': ''},
    {'prio': 2, 'artist': '', 'track': n, 'album': ''}, {'prio': 3, 'artist': '', 'track': b, 'album': ''},
    {'prio': 4, 'artist': '', 'track': n || ' | ' || b || ' |', 'album': ''}]) from p where kind = 3
  union all select title_id, unnest([
    {'prio': 0, 'artist': b, 'track': n, 'album': t}, {'prio': 1, 'artist': b, 'track': n, 'album': ''},
    {'prio': 2, 'artist': '', 'track': n, 'album': ''}, {'prio': 3, 'artist': '', 'track': b || ' - ' || n || ' | ' || t, 'album': ''}]) from p where kind = 4
  union all select title_id, unnest([
    {'prio': 0, 'artist': b, 'track': n, 'album': ''}, {'prio': 1, 'artist': '', 'track': n || ' - song and lyrics by ' || b, 'album': ''}]) from p where kind = 5
  union all select title_id, unnest([
    {'prio': 0, 'artist': b, 'track': n, 'album': ''}, {'prio': 1, 'artist': '', 'track': n, 'album': ''},
    {'prio': 2, 'artist': b || ' ' || first, 'track': second, 'album': ''}, {'prio': 3, 'artist': '', 'track': b || ' ' || n, 'album': ''},
    {'prio': 4, 'artist': b, 'track': b || ' ' || n, 'album': ''}]) from p where kind = 6
  union all select title_id, unnest(case when told then [
    {'prio': 0, 'artist': b, 'track': n, 'album': ''}, {'prio': 1, 'artist': first, 'track': second, 'album': ''}, {'prio': 2, 'artist': '', 'track': n, 'album': ''}]
    else [{'prio': 0, 'artist': first, 'track': second, 'album': ''}, {'prio': 1, 'artist': '', 'track': n, 'album': ''}] end) from p where kind = 7)
select title_id, c.prio as prio, c.artist as artist, c.track as track, c.album as album from c"""

ORACLE["title_pieces"] = """
select p_partkey, case p_partkey % 4 when 3 then p_brand || chr(39) || 's ' || p_name else p_name end as without_artist, p_brand as artist,
  case p_partkey % 4 when 3 then '123 ' || p_name else p_name end as unnumbered, case p_partkey % 4 when 3 then p_name || ': Live' else p_name end as quiet,
  case p_partkey % 4 when 2 then '(1)' else p_name end as gloss,
  p_partkey % 4 = 0 as noise, p_partkey % 4 = 1 as label, p_partkey % 4 < 3 as descriptor,
  ['เนื้อเพลง', '歌詞', '가사', 'lyrics'][p_partkey % 4 + 1] as term, case when p_partkey % 4 < 3 then 'k' || p_partkey end as video_id,
  case when p_partkey % 4 < 2 then lpad(p_partkey::varchar, 22, 'x') end as track_id
from part"""

ORACLE["lookup_requests"] = f"""
with {_CANDIDATES}, c as (select * from cands where prio < 3)
select distinct * from (
  select 'name' as kind, lower(artist) as key_artist, lower(track) as key_track, null::varchar as query from c where artist <> ''
  union all
  select 'search', null, null, case when artist <> '' then track || ' ' || artist else track end from c)"""

ORACLE["candidate_quality"] = f"""
with {_CANDIDATES}, t as (
  select c.title_id, max((lower(c.track) = lower(p.p_name))::int) as tr,
    max((lower(c.track) = lower(p.p_name) and (c.artist = '' or c.artist = p.p_brand))::int) as pr
  from cands c join part p on p.p_partkey = c.title_id group by all)
select count(*) as titles, sum(pr)::bigint as pairs, sum(tr)::bigint as tracks, sum(pr) / count(*) as pair_rate,
  sum(pr) >= ceil(count(*) * 0.85) as passed from t"""

ORACLE["exact_link"] = f"""
with {_CANDIDATES}, first as (select p_brand, p_name, min(p_partkey) as row_ord from part group by all),
hits as (select c.title_id, c.prio, f.row_ord from cands c join first f on lower(c.artist) = lower(f.p_brand) and lower(c.track) = lower(f.p_name) where c.prio < 3)
select title_id, min(prio) as prio, arg_min(row_ord, prio) as row_ord from hits group by title_id"""

_EVENTS = """
ev as (select user_id as "user", ts, event_id as ord, event_type as event, value,
  (props::json ->> '$.k')::int as k, 'yt:k' || (props::json ->> '$.k') as video_key from events)"""

ORACLE["link_by_video"] = f"""
with {_EVENTS}, links as (select 'yt:k' || ((100 + 2 * p_size) % 97) as video_key, min(p_partkey) as row_ord from part group by 1)
select ev.ord, ev.video_key, l.row_ord, case when l.row_ord is not null then 'video-id' end as "matchedBy"
from ev left join links l using (video_key)"""

_LINK = """
wants as (
  select distinct lower(p_type) as w_artist,
    trim(regexp_replace(substr(p_name, 1, (p_partkey % length(p_name))::int) || 'x' || substr(p_name, (p_partkey % length(p_name))::int + 2), ' +', ' ', 'g')) as w_track,
    (100 + 2 * p_size)::double as w_duration from part),
cat as (
  select lower(p_type) as r_artist, p_name as r_track, (100 + 2 * p_size)::double as r_duration, p_size % 2 = 0 as r_synced,
    min(p_partkey) as row_ord from part group by all),
near as (
  select *, levenshtein(w_track, r_track) as d, greatest(length(w_track), length(r_track)) as m,
    (w_artist = r_artist or (length(w_artist) >= 3 and length(r_artist) >= 3 and (contains(w_artist, r_artist) or contains(r_artist, w_artist)))
      or levenshtein(w_artist, r_artist) <= greatest(2, floor(0.2 * greatest(length(w_artist), length(r_artist))))) as strong,
    abs(w_duration - r_duration) as gap
  from wants cross join cat),
ok as (
  select * from near where case when d <= greatest(2, (m * 15) // 100) then strong or gap <= 5
    else (strong and d <= greatest(3, (m * 30) // 100)) or (gap <= 3 and d <= greatest(4, (m * 35) // 100)) end)"""

ORACLE["fuzzy_link"] = f"with {_LINK} select w_artist, w_track, w_duration, row_ord from ok"

_PICK = f"""{_LINK},
scored as (
  select *, d + 0.6::double * levenshtein(w_artist, r_artist) + (case when gap <= 10 then 0 else least((gap - 10) / 5, 8) end)
    - (case when r_synced then 2 else 0 end) as score from ok),
uniq as (
  select * from scored qualify row_number() over (partition by w_artist, w_track, w_duration, r_artist, r_track order by score, row_ord) = 1),
ranked as (
  select *, row_number() over (partition by w_artist, w_track, w_duration order by score, row_ord) - 1 as position from uniq)"""

ORACLE["score_pick"] = f"""
with {_PICK} select w_artist, w_track, w_duration, position, row_ord, round(score, 6) as score from ranked where position <= 5"""

ORACLE["match_quality"] = f"""
with {_PICK}, w as (
  select p_partkey, p_type, p_name, lower(p_type) as w_artist, (100 + 2 * p_size)::double as w_duration,
    trim(regexp_replace(substr(p_name, 1, (p_partkey % length(p_name))::int) || 'x' || substr(p_name, (p_partkey % length(p_name))::int + 2), ' +', ' ', 'g')) as w_track from part),
hits as (
  select w.p_partkey, r.r_synced, levenshtein(r.r_track, w.p_name) <= greatest(2, (greatest(length(r.r_track), length(w.p_name)) * 15) // 100)
    and (r.r_artist = lower(w.p_type) or levenshtein(r.r_artist, lower(w.p_type)) <= 2) as hit
  from w left join (select * from ranked where position = 0) r using (w_artist, w_track, w_duration))
select count(*) as titles, count(*) filter (where hit) as hits, count(*) filter (where hit and r_synced) as synced_hits,
  floor(100.0 * count(*) filter (where hit) / count(*) + 0.5)::bigint as hit_percent from hits"""

_BROAD = f"""{_LINK},
broad as (
  select * from (select *, list_distinct(string_split(w_track || ' ' || w_artist, ' ')) as wt, list_distinct(string_split(r_artist || ' ' || r_track, ' ')) as rt from ok)
  where len(list_intersect(wt, rt)) >= ceil(len(wt) * 0.5))"""

ORACLE["broad_search"] = f"with {_BROAD} select w_artist, w_track, w_duration, row_ord from broad"

ORACLE["confirmed_hits"] = f"""
with {_BROAD}
select w_artist, w_track, w_duration, row_ord, d as distance from broad where d <= greatest(2, (m * 15) // 100) and strong
qualify row_number() over (partition by w_artist, w_track, w_duration order by d, row_ord) = 1"""

ORACLE["token_search"] = f"""
with items as (select item_id, {norm('text')} as w from benchmark),
docs as (select {norm('text')} as r, min(doc_id) as row_ord from (select lower(text) as text, min(doc_id) as doc_id from documents group by lower(text)) group by 1),
tokens as (select item_id, w, list_distinct(string_split(w, ' ')) as wt from items),
dt as (select row_ord, r, list_distinct(string_split(r, ' ')) as rt from docs),
hits as (select item_id, row_ord, (levenshtein(w, r) + 3)::double as score from tokens join dt on list_has_all(rt, wt)
  qualify row_number() over (partition by item_id order by levenshtein(w, r), row_ord) = 1)
select item_id, row_ord, round(score, 6) as score from items left join hits using (item_id)"""

ORACLE["waterfall"] = """
with src as (select lower(p_brand) as b, lower(p_name) as n,
    case when p_type in ('SMALL', 'LARGE') then 'community' when p_type in ('ECONOMY', 'PROMO') then 'main' else 'fallback' end as source,
    min(p_partkey) as row_ord from part group by all),
hit as (select p.p_partkey as want_id, s.source, s.row_ord,
    row_number() over (partition by p.p_partkey order by case s.source when 'community' then 0 when 'main' then 1 else 2 end) as rn
  from part p join src s on s.b = lower(p.p_brand) and s.n = lower(p.p_name))
select want_id, source, row_ord from hit where rn = 1"""

ORACLE["resolved_songs"] = f"""
with {_EVENTS}, r as (
  select "user"::varchar || '-' || k::varchar as song, ord as prio, event in ('purchase', 'signup') as synced,
    case when event = 'signup' then 'video-id' else 'name' end as "matchedBy", case when event <> 'click' then value end as score
  from ev where event <> 'error')
select song, prio, synced, "matchedBy" from r
qualify row_number() over (partition by song order by ("matchedBy" = 'video-id' and synced) desc, synced desc,
  case when synced then prio end nulls last, coalesce(score, case when synced then -5 else 50 end), prio) = 1"""

ORACLE["catalog_responses"] = """
select p_partkey, p_brand as "artistName", p_name as "trackName", p_size::int as duration
from part, unnest(case when p_partkey % 2 = 0 then [1] else [1, 2] end) where p_size % 2 = 0"""

_U = r"regexp_extract(url, '^[a-z]+://([^/?#]+)([^?#]*)(?:\?([^#]*))?', {})"
_HOST, _PATH, _QUERY = (_U.format(i) for i in (1, 2, 3))
ORACLE["video_keys"] = f"""
with u as (select page_id, url, regexp_replace(lower({_HOST}), '^www\\.', '') as host, case when {_PATH} = '' then '/' else {_PATH} end as path from pages)
select page_id, host || regexp_replace(path, '/+$', '') as video_key, path as path_key, '||' as caption_key, 'web' as site,
  true as fetchable, false as moved from u"""

ORACLE["page_text"] = r"""
with a as (select page_id, regexp_extract(html, '(?s)<article>(.*)</article>', 1) as h from pages),
t as (select page_id, regexp_replace(regexp_replace(h, '(?i)<br\s*/?>|</(?:p|div)>', chr(10), 'g'), '<[^>]+>', '', 'g') as h from a),
d as (select page_id, replace(replace(replace(replace(replace(replace(replace(replace(h, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
  '&#39;', ''''), '&#039;', ''''), '&apos;', ''''), '&nbsp;', ' ') as h from t),
f as (select page_id, regexp_replace(regexp_replace(h, '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g') as h from d),
c as (select page_id, regexp_replace(regexp_replace(h, '^\s+', ''), '\s+$', '') as text from f)
select page_id, md5(text) as text_md5, length(text) as chars from c where length(text) >= 30"""

ORACLE["page_metadata"] = r"""
with t as (select page_id, url, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as h from pages),
d as (select page_id, url, trim(replace(replace(h, '&amp;', '&'), '&quot;', '"')) as title from t)
select page_id, case when page_id % 3 = 2 then 'x' else title end as track, case when page_id % 3 = 2 then url else 'Band' end as artist,
  case page_id % 3 when 0 then 'schema' when 1 then 'ytInitialPlayerResponse' else 'dom' end as source
from d where page_id % 3 = 2 or title <> ''"""

ORACLE["document_tokens"] = r"""
select doc_id, len(regexp_extract_all(text, '\S+'))::int as words, len(regexp_extract_all(text, '\s+'))::int as separators, true as lossless from documents"""

# ── Time-coded text ──────────────────────────────────────────────────────────

_TEXT_LINES = """
raw as (select conv_id || '-' || turn as id, conv_id, turn, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from conversations),
lines as (select id, turn, i, trim(regexp_replace(line, '\\s+', ' ', 'g')) as text from raw)"""

ORACLE["lrc_lines"] = f"""
with {_TEXT_LINES}, stamped as (
  select id, i, 0 as j, 7.0 * i as time, text from lines where text <> '' union all select id, i, 1, 1800.0, text from lines where text <> '' and i = 0)
select id as song_id, (row_number() over (partition by id order by time, i, j) - 1)::int as line_idx, time::double as time, text from stamped"""

ORACLE["caption_cues"] = f"""
with {_TEXT_LINES}
select id as doc_id, (row_number() over (partition by id order by i) - 1)::int as cue_idx, (7.0 * i)::double as time, text from lines where text <> ''"""

_SONG = """
song as (select conv_id as song_id, turn::int as line_idx, turn * 7.5 + 6 as time, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as words from conversations),
ended as (select *, lead(time) over (partition by song_id order by line_idx) as nxt, lead(line_idx) over (partition by song_id order by line_idx) as nxt_idx from song)"""

ORACLE["line_ends"] = f"""
with {_SONG} select song_id, line_idx, time::double as time, coalesce(nxt, time + 4)::double as "end" from ended"""

_GAPS = f"""{_SONG},
gaps as (
  select song_id, 0.0::double as "start", time::double as "end", 0 as next_idx from ended where line_idx = 0 and time > 5
  union all
  select song_id, (time::double + (len(words) - 1) / 20 + 1.2), nxt::double, nxt_idx from ended
  where len(words) > 0 and nxt::double - (time::double + (len(words) - 1) / 20 + 1.2) > 5)"""

ORACLE["lyric_gaps"] = f"""
with {_GAPS} select song_id, round("start", 6) as "start", round("end", 6) as "end", next_idx from gaps"""

ORACLE["pages_of_lines"] = "select conv_id as song_id, turn::int as line_idx, (turn // 3)::bigint as page from conversations"

_TICKS = """
ticks as (select conv_id || '-' || turn || '-' || x.i as tick_id, conv_id as song_id, (turn * 7.5 + x.s)::double as t, turn % 2 = 1 as paused
  from conversations, (values (0, 0.0), (1, 2.5), (2, 5.25)) x(i, s)),
clock as (select *, t + case when paused then 0 else 0.05 end as at from ticks)"""

_ASOF = f"""{_SONG}, {_TICKS},
placed as (select c.tick_id, c.song_id, c.at, coalesce(s.line_idx, -1)::int as line_idx from clock c asof left join song s on c.song_id = s.song_id and c.at >= s.time)"""

ORACLE["tick_line_asof"] = f"with {_ASOF} select tick_id, song_id, line_idx from placed"

ORACLE["tick_gap"] = f"""
with {_GAPS}, {_TICKS}
select c.tick_id, min(case when c.at >= g."start" and c.at < g."end" - 1 then g.next_idx end)::int as gap_idx,
  min(case when c.at >= g."end" - 1 and c.at < g."end" then g.next_idx end)::int as staged_idx
from clock c left join gaps g using (song_id) group by c.tick_id"""

ORACLE["tick_word"] = f"""
with {_ASOF}, w as (
  select e.song_id, e.line_idx, e.time::double as time, coalesce(e.nxt, e.time + 4)::double as line_end, len(words) as n, unnest(words) as word, generate_subscripts(words, 1) - 1 as word_idx from ended e),
b as (select *, time + word_idx / 20 as a, case when word_idx + 1 < n then time + (word_idx + 1) / 20 else line_end end as z from w)
select p.tick_id, b.word_idx::int as word_idx, b.word, case when p.at >= z then 'sung' when p.at >= a then 'singing' else 'upcoming' end as state
from placed p join b on p.song_id = b.song_id and p.line_idx = b.line_idx"""

ORACLE["dedupe_captions"] = f"""
with {_EVENTS}, s as (select *, lag(event) over (partition by "user" order by ord) as b from ev)
select "user" as doc_id, ord as cue_idx, event as text, round(greatest(value - 0.3, 0), 6) as time from s where event is distinct from b"""

ORACLE["playback_grid"] = f"""
with {_EVENTS}, s as (select *, epoch_us(ts) // 1000 as ms, lead(epoch_us(ts) // 1000) over (partition by "user" order by ts, ord) as nx from ev),
g as (select *, ((ms + 3599999) // 3600000) * 3600000 as a, coalesce(((nx + 3599999) // 3600000) * 3600000 - 3600000, ((ms + 3599999) // 3600000) * 3600000) as z from s),
x as (select *, unnest(generate_series(a, z, 3600000)) as gm from g where z >= a)
select "user", gm * 1000 as at, round(case when event = 'error' then value else value + (gm - ms) / 1000 end, 3) as t from x"""

ORACLE["pause_detection"] = f"""
with {_EVENTS}, s as (select *, event is distinct from lag(event) over (partition by "user" order by ts, ord) as ch from ev),
l as (select *, max(case when ch then epoch_ms(ts) end) over (partition by "user" order by ts, ord rows unbounded preceding) as since from s)
select ord, epoch_ms(ts) - since > 43200000 as paused from l"""

# ── Usage ────────────────────────────────────────────────────────────────────


def _segments(silent: str) -> str:
    return f"""{_EVENTS},
e1 as (select *, row_number() over u as rn, lead(ts) over u as nxt from ev window u as (partition by "user" order by ts, ord)),
e2 as (select *, max(case when event = 'signup' then rn end) over (partition by "user" order by rn rows unbounded preceding) as st,
  case when event in ('signup', 'click') then case k % 3 when 0 then 'stft' when 1 then 'basic' else 'stft_deep' end end as mode from e1),
e3 as (select *, {silent} as silent,
  first_value(video_key) over (partition by "user", st order by rn) as tab_key,
  last_value(mode ignore nulls) over (partition by "user" order by rn rows unbounded preceding) as mode_now,
  lag(case when event = 'purchase' then rn end) over (partition by "user" order by rn) as unused from e2 where st is not null),
e4 as (select *, case when silent or event = 'error' then 0 when event = 'signup' then 1 end as state,
  case event when 'signup' then video_key when 'click' then tab_key when 'purchase' then video_key end as claim from e3),
e5 as (select *, coalesce(last_value(state ignore nulls) over b, 0) as open_, last_value(claim ignore nulls) over b as cur
  from e4 window b as (partition by "user", st order by rn rows between unbounded preceding and 1 preceding)),
e6 as (select *, event = 'signup' or (open_ = 1 and (event = 'click' or (event = 'purchase' and claim <> cur))) as opens, open_ = 1 and event = 'error' as closes
  from e5 where open_ = 1 or event = 'signup'),
sold as (select "user", ts as sold_ts, video_key as sold_key, k as sold_k from ev where event = 'purchase'),
e7 as (select e6.*, s.sold_key, s.sold_k from e6 asof left join sold s on e6."user" = s."user" and e6.ts > s.sold_ts),
e8 as (select *, max(case when opens then rn end) over m as seg, max(case when opens and event <> 'click' then rn end) over m as meta_from,
  case when event = 'purchase' then k when event = 'signup' and sold_key = video_key then sold_k end as told
  from e7 window m as (partition by "user", st order by rn rows unbounded preceding)),
e9 as (select *, last_value(told ignore nulls) over (partition by "user", st, meta_from order by rn rows unbounded preceding) as song_k from e8),
closed as (
  select "user", seg, max(case when opens then claim end) as "videoKey", max(case when opens then mode_now end) as "filterMode",
    'Song ' || arg_max(song_k, rn)::varchar as "songTitle", 'Track ' || arg_max(song_k, rn)::varchar as "trackName", 'Artist ' || (arg_max(song_k, rn) % 10)::varchar as "artistName", min(case when opens then ts end) as started,
    max(case when event = 'view' or opens then ts end) as beat, min(case when closes then ts end) as closed_at,
    bool_or(silent and not closes) as gone, max(rn) as last_rn, arg_max(nxt, rn) as any_after
  from e9 group by all),
closed2 as (select c.*, e.nxt as after from closed c join e1 e on c."user" = e."user" and c.last_rn = e.rn)"""


_SEGMENTS = f"""{_segments("coalesce(epoch_us(nxt) - epoch_us(ts) > 43200000000, false)")},
timed as (select *, coalesce(closed_at, case when gone then beat end, after, beat) as ended from closed2),
seg as (select "user", "videoKey", "filterMode", "songTitle", "trackName", "artistName", floor((epoch_us(ended) - epoch_us(started)) / 1000000 + 0.5)::bigint as seconds, started, ended
  from timed where floor((epoch_us(ended) - epoch_us(started)) / 1000000 + 0.5) >= 3)"""

_SEGMENT_COLUMNS = """select "user", "videoKey", "filterMode", "songTitle", "trackName", "artistName", 'https://www.youtube.com/watch?v=' || substr("videoKey", 4) as "videoUrl", seconds, epoch_us(started) as started_us, epoch_us(ended) as ended_us from seg"""

ORACLE["listen_segments"] = f"with {_SEGMENTS} {_SEGMENT_COLUMNS}"

# The stream knows no silence: a segment is open until an event ends it, or the log.
ORACLE["segments_stream"] = f"""
with {_segments("false")},
timed as (select *, coalesce(closed_at, after, beat) as ended from closed2),
seg as (select "user", "videoKey", "filterMode", "songTitle", "trackName", "artistName", floor((epoch_us(ended) - epoch_us(started)) / 1000000 + 0.5)::bigint as seconds, started, ended
  from timed where floor((epoch_us(ended) - epoch_us(started)) / 1000000 + 0.5) >= 3)
{_SEGMENT_COLUMNS}"""

ORACLE["usage_totals"] = f"""
with {_SEGMENTS} select "user", sum(seconds)::bigint as "totalSeconds", count(distinct "videoKey") as "uniqueSongs", count(*)::bigint as "sessionCount" from seg group by 1"""

ORACLE["usage_by_mode"] = f"""
with {_SEGMENTS} select "user", "filterMode", sum(seconds)::bigint as seconds from seg group by grouping sets (("user", "filterMode"), ("user"))"""

ORACLE["top_songs"] = f"""
with {_SEGMENTS}, s as (select "user", "videoKey", sum(seconds)::bigint as seconds from seg group by 1, 2)
select "user", "videoKey", seconds, row_number() over (partition by "user" order by seconds desc, "videoKey")::int as rank from s qualify rank <= 3"""

ORACLE["scoreboard"] = f"""
with {_SEGMENTS}, p as (select *, unnest([strftime(ended, '%Y-%m'), 'all']) as period from seg),
t as (select period, "user", sum(seconds)::bigint as "totalSeconds", count(distinct "videoKey") as songs from p group by 1, 2)
select period, "user", rank() over (partition by period order by "totalSeconds" desc) as rank, count(*) over (partition by period) as "totalSingers", "totalSeconds", songs from t"""

ORACLE["achievements"] = f"""
with {_SEGMENTS}, p as (select "user", sum(seconds)::bigint as progress from seg group by 1),
tiers as (select distinct 'Tier ' || p_size as name, (p_size * 20000)::bigint as threshold from part)
select "user", sum((progress >= threshold)::int)::bigint as "earnedCount", count(*) as "allCount",
  arg_min(name, case when progress < threshold then threshold end) as "nextTier",
  greatest(0, min(case when progress < threshold then threshold end) - max(progress))::bigint as remaining
from p cross join tiers group by 1"""

_QUEUE = """
q as (select o_custkey as host, year(o_orderdate) as room, o_orderpriority as guest, o_orderstatus || '-' || o_orderpriority as song, o_orderstatus = 'F' as played from orders)"""

ORACLE["party_stats"] = f"""
with {_QUEUE} select host, count(*) as "songsQueued", count(*) filter (where played) as "songsPlayed", count(distinct room) as parties, count(distinct guest) as guests from q group by 1"""

ORACLE["party_top_songs"] = f"""
with {_QUEUE}, s as (select host, song, count(*) as times from q group by 1, 2)
select host, song, times, row_number() over (partition by host order by times desc, song)::int as rank from s qualify rank <= 2"""

ORACLE["queue_depth"] = f"""
with {_EVENTS},
s as (select "user", ts, ord, sum(case event when 'view' then 1 when 'purchase' then -1 else 0 end) over w as s from ev window w as (partition by "user" order by ts, ord rows unbounded preceding))
select ord, (s - least(0, min(s) over (partition by "user" order by ts, ord rows unbounded preceding)))::bigint as depth from s"""

# ── Feedback ─────────────────────────────────────────────────────────────────

_VOTES = f"""{_EVENTS},
votes as (select "user", video_key, ts, ord, case event when 'purchase' then true when 'error' then false end as liked, case when event = 'view' then (ord % 6)::int end as rating
  from ev where event in ('purchase', 'error', 'view')),
newest as (select * from votes qualify row_number() over (partition by "user", video_key order by ts desc, ord desc) = 1),
said as (select *, coalesce(liked, case when rating > 0 then rating >= 4 end) as yes from newest),
tally as (select video_key, count(*) filter (where yes) as likes, count(*) filter (where not yes) as dislikes from said group by 1)"""

ORACLE["vote_tally"] = f"""
with {_VOTES} select *, case when likes + dislikes > 0 then floor(100.0 * likes / (likes + dislikes) + 0.5)::bigint end as share from tally"""

ORACLE["latest_votes"] = f'with {_VOTES} select "user", video_key, ord from newest'

ORACLE["star_average"] = f"with {_VOTES} select video_key, round(avg(rating), 6) as avg, count(*) as count from votes where rating > 0 group by 1"

ORACLE["stats_lookup"] = f"""
with {_VOTES}, asked as (select distinct 'yt:k' || (p_size * 4) as video_key from part)
select video_key, coalesce(likes, 0) as likes, coalesce(dislikes, 0) as dislikes from asked left join tally using (video_key)"""

ORACLE["vote_records"] = f"""
with {_EVENTS} select video_key as "videoKey", case event when 'purchase' then 'like' else 'dislike' end as vote, case event when 'purchase' then 5 else 1 end as rating, count(*) as n
from ev where event in ('purchase', 'error') group by all"""

_OUTCOMES = f"""{_EVENTS},
told as (select video_key, ts, ord, case ord % 5 when 0 then 'queued' when 1 then 'rate_limited' when 2 then 'already_synced' when 3 then 'upstream' else 'recently_failed' end as reason from ev where event = 'error'),
kept as (select * from told where reason <> 'upstream' qualify row_number() over (partition by video_key order by ts desc, ord desc) = 1),
ttl as (select video_key, reason, ts, case reason when 'queued' then ts + interval 30 day when 'rate_limited' then ts + interval 1 day
  when 'already_synced' then timestamp '9999-12-31' else ts + interval 7 day end as expires from kept)"""

ORACLE["ttl_outcomes"] = f"with {_OUTCOMES} select video_key, reason, epoch_us(ts) as at, epoch_us(expires) as until from ttl"

ORACLE["unrequested"] = f"""
with {_OUTCOMES},
held as (select video_key, ts, case reason when 'queued' then ts + interval 30 day when 'rate_limited' then ts + interval 1 day
  when 'already_synced' then timestamp '9999-12-31' else ts + interval 7 day end as expires
  from told where reason <> 'upstream' qualify row_number() over (partition by video_key, ts order by ord desc) = 1)
select p.ord, p.video_key from (select * from ev where event = 'purchase') p asof left join held h on p.video_key = h.video_key and p.ts >= h.ts
where h.expires is null or h.expires <= p.ts"""

ORACLE["sync_eligible"] = f"""
with {_OUTCOMES} select conv_id, turn, 'https://www.youtube.com/watch?v=k' || conv_id as url from conversations c
where turn <> 3 and role <> '' and len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) >= 4
  and not exists (select 1 from ttl where ttl.video_key = 'yt:k' || c.conv_id and expires > timestamp '2024-02-01')"""

ORACLE["negative_cache"] = f"""
with {_EVENTS}, told as (select video_key, ts, event from ev where event in ('error', 'signup'))
select l.ord, coalesce(t.event = 'error' and epoch_us(l.ts) - epoch_us(t.ts) < 86400000000, false) as suppressed
from (select * from ev where event = 'view') l asof left join told t on l.video_key = t.video_key and l.ts >= t.ts"""

ORACLE["demand_votes"] = f'with {_EVENTS} select video_key as song_key, count(distinct "user") as votes from ev group by 1'

ORACLE["keep_newest"] = f'with {_EVENTS} select "user", ord as key from ev qualify row_number() over (partition by "user" order by ts desc, ord) <= 5'

ORACLE["debounce"] = f"""
with {_EVENTS}, s as (select *, lead(ts) over (partition by "user" order by ts, ord) as nx from ev)
select "user", ord from s where nx is null or epoch_us(nx) - epoch_us(ts) >= 7200000000"""

ORACLE["distinct_until_changed"] = f"""
with {_EVENTS}, s as (select *, lag(event) over (partition by "user" order by ts, ord) as b from ev) select "user", ord, event from s where event is distinct from b"""

ORACLE["once_per_key"] = f"with {_EVENTS} select video_key, arg_min(ord, ts) as ord from ev group by 1"

ORACLE["drop_stale"] = f"""
with {_EVENTS}, g as (select *, day(ts) - ord % 5 as generation from ev)
select video_key, ord from g qualify generation = max(generation) over (partition by video_key order by ts, ord rows unbounded preceding)"""

ORACLE["identity_guard"] = f"""
with {_EVENTS}, b as (select * from ev where event = 'purchase')
select e.ord from (select *, 'yt:k' || (k - k % 2) as asked from ev) e asof join b on e."user" = b."user" and e.ts >= b.ts where b.video_key = e.asked"""

# ── Playlists (caps of 50 lists and 500 items, which these logs do not reach) ──

_LISTS = f"""{_EVENTS},
log as (select "user"::varchar as "user", ord as seq, case event when 'signup' then 'create' when 'view' then 'add' when 'click' then 'rename' when 'purchase' then 'remove' else 'delete' end as action,
  max(case when event = 'signup' then ord end) over (partition by "user" order by ts, ord rows unbounded preceding) as made, 'name ' || k as name, 'k' || (k % 4) as video_key from ev),
life as (select "user", made, min(case when action = 'create' then seq end) as a, min(case when action = 'delete' then seq end) as z, min(case when action = 'create' then name end) as name from log where made is not null group by 1, 2),
lg as (select log.*, a, z, a is not null and seq > a and (z is null or seq < z) as alive from log left join life using ("user", made)),
steps as (select *, coalesce(lag(action) over (partition by "user", made, video_key order by seq) = 'add', false) as held from lg where alive and action in ('add', 'remove')),
live as (select * from life where z is null)"""

ORACLE["playlist_outcomes"] = f"""
with {_LISTS}
select l."user", l.seq, l.action,
  case l.action when 'create' then true when 'rename' then l.alive when 'delete' then coalesce(l.seq = l.z, false) when 'add' then l.alive and not coalesce(s.held, false) else l.alive end as ok,
  case when l.action = 'create' then 'ok' when l.action = 'delete' then case when l.seq = l.z then 'ok' else 'no_list' end
    when not l.alive then 'no_list' when l.action = 'rename' then 'ok' when l.action = 'remove' then 'removed' when s.held then 'duplicate' else 'added' end as result
from lg l left join steps s on s."user" = l."user" and s.seq = l.seq"""

# One change of every user a step; items are kept as list|key.
ORACLE["playlist_caps"] = f"""
with recursive {_LISTS},
turns as (select "user", seq, action, case when action = 'create' then 'L' || seq when made is null then 'none' else 'L' || made end as lid, video_key as vkey, row_number() over (partition by "user" order by seq) as rn from lg),
run as (
  select "user", 0::bigint as rn, []::varchar[] as lists, []::varchar[] as items, null::bigint as seq, null::varchar as action, null::boolean as ok, null::varchar as result from (select distinct "user" from turns)
  union all
  select t."user", t.rn,
    case when t.action = 'create' and len(lists) < 2 then list_append(lists, lid) when t.action = 'delete' then list_filter(lists, lambda x: x <> lid) else lists end,
    case when t.action = 'delete' then list_filter(items, lambda x: not starts_with(x, lid || '|'))
      when t.action = 'add' and list_contains(lists, lid) and not list_contains(items, lid || '|' || vkey) and len(list_filter(items, lambda x: starts_with(x, lid || '|'))) < 2 then list_append(items, lid || '|' || vkey)
      when t.action = 'remove' then list_filter(items, lambda x: x <> lid || '|' || vkey) else items end,
    t.seq, t.action,
    case t.action when 'create' then len(lists) < 2 when 'add' then list_contains(lists, lid) and not list_contains(items, lid || '|' || vkey) and len(list_filter(items, lambda x: starts_with(x, lid || '|'))) < 2 else list_contains(lists, lid) end,
    case when t.action = 'create' then case when len(lists) < 2 then 'ok' else 'too_many' end when not list_contains(lists, lid) then 'no_list'
      when t.action = 'remove' then 'removed' when t.action <> 'add' then 'ok'
      when len(list_filter(items, lambda x: starts_with(x, lid || '|'))) >= 2 then 'full' when list_contains(items, lid || '|' || vkey) then 'duplicate' else 'added' end
  from run r join turns t on t."user" = r."user" and t.rn = r.rn + 1)
select "user", seq, action, ok, result from run where rn > 0"""

ORACLE["playlist_state"] = f"""
with {_LISTS}, final as (select "user", made, video_key, arg_max(action, seq) as act from steps group by 1, 2, 3),
sizes as (select "user", made, count(*) as n from final where act = 'add' group by 1, 2),
names as (select "user", made, arg_max(name, seq) as nm from lg where action = 'rename' and alive group by 1, 2)
select l."user", 'L' || l.made as list_id, coalesce(n.nm, l.name) as name, coalesce(s.n, 0) as size from live l left join sizes s using ("user", made) left join names n using ("user", made)"""

ORACLE["default_lists"] = f"""
with {_LISTS}, last as (select "user", max(made) as made from life group by 1), first as (select "user", min(made) as made from live group by 1),
users as (select "user" from last)
select u."user", 'L' || coalesce(v.made, f.made) as active_id from users u left join (select last.* from last join live using ("user", made)) v using ("user") left join first f using ("user")"""

# ── Signal ───────────────────────────────────────────────────────────────────

_CLIP = "clip as (select vec_id as block_idx, embedding[1:32]::double[] as l, embedding[33:64]::double[] as r from embeddings)"

ORACLE["center_cancel"] = f"""
with {_CLIP}, o as (select block_idx, list_transform(range(1, 33), lambda i: l[i] * 0.15 + (l[i] - r[i]) * 0.5 * 0.85) as a, list_transform(range(1, 33), lambda i: r[i] * 0.15 + (r[i] - l[i]) * 0.5 * 0.85) as b from clip)
select block_idx, round(list_sum(list_transform(a, lambda x: x * x)), 6) as energy, round(list_sum(b), 6) as right_sum from o"""

ORACLE["frame_energy"] = f"""
with {_CLIP}, e as (select block_idx, list_sum(list_transform(l, lambda x: x * x)) as s from clip),
w as (select block_idx // 16 as frame_idx, block_idx, sum(s) over (order by block_idx rows between current row and 63 following) as energy, count(*) over (order by block_idx rows between current row and 63 following) as n from e)
select frame_idx, round(energy, 4) as energy from w where block_idx % 16 = 0 and n = 64"""

ORACLE["signal_quality"] = f"""
with {_CLIP}, e as (select sqrt(sum(list_sum(list_transform(l, lambda x: x * x))) / sum(len(l))) as rms from clip)
select 'all' as clip_id, 0.5::double as ratio, true as finite, round(rms, 4) as rms_in from e"""

# Fourier sums in two steps: 2048 = 64 x 32, so a sum over all samples is one over 64 of them for each
# of 32 remainders, then one over the remainders. Blocks hold 32 samples at 48 kHz.
_SAMPLES = f"""{_CLIP},
samples as (select block_idx * 32 + i - 1 as t, l[i]::double as l, r[i]::double as r from clip, range(1, 33) _(i)),
extent as (select max(t) + 1 as size from samples),
turn as (select list(cos(2 * pi() * j / 2048) order by j) as c, list(sin(2 * pi() * j / 2048) order by j) as s from range(0, 2048) _(j)),
starts as (select f from extent, range(0, ((size - 2048) // 512 + 1)::bigint) _(f) where size >= 2048),
framed as (select f, t - f * 512 as n, (0.5 - 0.5 * cos(2 * pi() * (t - f * 512) / 2048)) as w, l, r from starts join samples on t >= f * 512 and t < f * 512 + 2048),
inner1 as (select f, n % 32 as q, k6, sum(l * w * c[1 + 32 * ((n // 32) * k6 % 64)]) as lc, sum(l * w * s[1 + 32 * ((n // 32) * k6 % 64)]) as ls,
    sum(r * w * c[1 + 32 * ((n // 32) * k6 % 64)]) as rc, sum(r * w * s[1 + 32 * ((n // 32) * k6 % 64)]) as rs
  from framed, turn, range(0, 64) _(k6) group by all),
spectrum as (select f, k, sum(lc * c[1 + k * q % 2048] - ls * s[1 + k * q % 2048]) as la, sum(-lc * s[1 + k * q % 2048] - ls * c[1 + k * q % 2048]) as lb,
    sum(rc * c[1 + k * q % 2048] - rs * s[1 + k * q % 2048]) as ra, sum(-rc * s[1 + k * q % 2048] - rs * c[1 + k * q % 2048]) as rb
  from inner1, turn, range(0, 1025) _(k) where k % 64 = k6 group by all)"""


def _centered(depth: float) -> str:
    """Centerness of each bin."""
    power = max(1.5 - 1.2 * depth, 0.3)
    return f"""parts{depth:.0f} as (select *, la * la + lb * lb as pl, ra * ra + rb * rb as pr, k * 48000 / 2048 as hz from spectrum),
sharp{depth:.0f} as (select *, pow(2 * sqrt(pl * pr) / (pl + pr + 1e-9) * least(1, greatest(0, (la * ra + lb * rb) / (sqrt(pl * pr) + 1e-9))), {power}) as x from parts{depth:.0f}),
centered{depth:.0f} as (select *, x + {0.2 * depth} * (1 - x) as centerness from sharp{depth:.0f})"""


def _trapezoid_sql(a: float, b: float, c: float, d: float) -> str:
    return f"(0.5 - 0.5 * cos(pi() * least(1, greatest(0, (hz - {a}) / ({b} - {a})), greatest(0, ({d} - hz) / ({d} - {c})))))"


def _filtered_sql(depth: float, atten: float) -> str:
    """Blocks of the filtered clip, from block 64 on (a frame late): ``out{depth}(block_idx, i, l, r)``."""
    n = f"{depth:.0f}"
    band = _trapezoid_sql(90, 160 - 60 * depth, 9000 + 1500 * depth, 12000 + 1500 * depth)
    strength = atten + depth * (1 - atten) * 0.85
    return f"""{_centered(depth)},
gain{n} as (select *, case when k = 0 then 0 else {band} end as band, 1 - {0.7 * depth} * {_trapezoid_sql(180, 300, 5000, 8000)} as thin from centered{n}),
kept{n} as (select f, k, la, lb, ra, rb, 1 - least(1, {strength} * band * centerness) as mid, case when band > 0 then thin else 1 end as side from gain{n}),
half{n} as (select f, k, (mid * (la + ra) + side * (la - ra)) / 2 as la, (mid * (lb + rb) + side * (lb - rb)) / 2 as lb,
    (mid * (la + ra) - side * (la - ra)) / 2 as ra, (mid * (lb + rb) - side * (lb - rb)) / 2 as rb from kept{n}),
full{n} as (select f, k, la, case when k in (0, 1024) then 0 else lb end as lb, ra, case when k in (0, 1024) then 0 else rb end as rb from half{n}
  union all select f, 2048 - k, la, -lb, ra, -rb from half{n} where k between 1 and 1023),
back{n} as (select f, k % 32 as b, n6, sum(la * c[1 + 32 * ((k // 32) * n6 % 64)] - lb * s[1 + 32 * ((k // 32) * n6 % 64)]) as lx, sum(la * s[1 + 32 * ((k // 32) * n6 % 64)] + lb * c[1 + 32 * ((k // 32) * n6 % 64)]) as ly,
    sum(ra * c[1 + 32 * ((k // 32) * n6 % 64)] - rb * s[1 + 32 * ((k // 32) * n6 % 64)]) as rx, sum(ra * s[1 + 32 * ((k // 32) * n6 % 64)] + rb * c[1 + 32 * ((k // 32) * n6 % 64)]) as ry
  from full{n}, turn, range(0, 64) _(n6) group by all),
waves{n} as (select f, n, sum((0.5 - 0.5 * cos(2 * pi() * n / 2048)) / 2048 * (lx * c[1 + b * n % 2048] - ly * s[1 + b * n % 2048])) as l,
    sum((0.5 - 0.5 * cos(2 * pi() * n / 2048)) / 2048 * (rx * c[1 + b * n % 2048] - ry * s[1 + b * n % 2048])) as r
  from back{n}, turn, range(0, 2048) _(n) where n % 64 = n6 group by all),
added{n} as (select f * 512 + n + 2048 as t, sum(l) as l, sum(r) as r from waves{n} group by all),
out{n} as (select s.t // 32 as block_idx, s.t % 32 as i, coalesce(a.l, 0)::float::double as l, coalesce(a.r, 0)::float::double as r from samples s left join added{n} a using (t))"""


ORACLE["frame_features"] = f"""
with {_SAMPLES}, {_centered(0.0)}
select f as frame_idx, round(avg(centerness), 4) as centerness from centered0 group by all"""

ORACLE["stft_filter"] = f"""
with {_SAMPLES}, {_filtered_sql(0.0, 0.85)}
select block_idx, round(sqrt(avg(l * l)), 4) as rms from out0 group by all"""

# The low-pass at 150 Hz, block by block: what is left of the state, and what the block adds.
_STEP = "((1.0 / 48000) / (1.0 / (2.0 * pi() * 150.0) + 1.0 / 48000))"
_BASIC = f"""
adds as (select block_idx, l, r, list_sum(list_transform(range(1, 33), lambda i: {_STEP} * pow(1 - {_STEP}, 32 - i) * l[i])) as el,
    list_sum(list_transform(range(1, 33), lambda i: {_STEP} * pow(1 - {_STEP}, 32 - i) * r[i])) as er from clip),
states as (select 0::bigint as block_idx, 0.0::double as cl, 0.0::double as cr
  union all select s.block_idx + 1, pow(1 - {_STEP}, 32) * cl + coalesce(el, 0), pow(1 - {_STEP}, 32) * cr + coalesce(er, 0)
    from states s left join adds a using (block_idx) where s.block_idx < (select max(block_idx) from clip)),
lows as (select block_idx, i, l[i] as l, r[i] as r,
    pow(1 - {_STEP}, i) * cl + list_sum(list_transform(range(1, i + 1), lambda j: {_STEP} * pow(1 - {_STEP}, i - j) * l[j])) as bl,
    pow(1 - {_STEP}, i) * cr + list_sum(list_transform(range(1, i + 1), lambda j: {_STEP} * pow(1 - {_STEP}, i - j) * r[j])) as br
  from states join clip using (block_idx), range(1, 33) _(i)),
basic as (select block_idx, i - 1 as i, (l * 0.15 + (bl + (l - bl - r + br) / 2) * 0.85)::float::double as l, (r * 0.15 + (br - (l - bl - r + br) / 2) * 0.85)::float::double as r from lows)"""

ORACLE["basic_mode"] = f"""
with recursive {_CLIP}, {_BASIC}
select block_idx, round(sqrt(avg(l * l)), 4) as rms from basic group by all"""

ORACLE["modes"] = f"""
with recursive {_SAMPLES}, {_BASIC}, {_filtered_sql(0.0, 0.85)}, {_filtered_sql(1.0, 0.85)},
every as (select 'basic' as clip_id, * from basic union all select 'other', * from basic union all select 'stft', * from out0 union all select 'stft_deep', * from out1
  union all select 'passthrough_muted', block_idx, i, 0.0, 0.0 from basic)
select clip_id, block_idx, round(sqrt(avg(l * l)), 4) as rms_left, round(sqrt(avg(r * r)), 4) as rms_right from every group by all"""

# ── Records ──────────────────────────────────────────────────────────────────

ORACLE["request_outcomes"] = """
select 'yt:k' || p_partkey as "videoKey", case when p_type = 'PROMO' then 'upstream' when p_size < 20 then 'queued' when p_size < 30 then 'unauthenticated'
  when p_type = 'SMALL' then 'upstream' else lower(p_type) end as reason from part"""

ORACLE["valid_signals"] = f"""
with {_EVENTS}, s as (select case event when 'purchase' then 'explicit_up' when 'error' then 'explicit_down' else 'other' end as signal, k from ev)
select signal, signal <> 'other' and k > 50 as ok, count(*) as n from s group by all"""

ORACLE["time_texts"] = f"""
with {_EVENTS}, s as (select ord, event = 'error' as paused, (floor(value) * 60 + k)::bigint as seconds from ev)
select ord, seconds, (case when paused then seconds else seconds + 2 end)::double as playhead from s"""

ORACLE["stored_snapshots"] = f"""
with {_EVENTS} select ord as "user", case when event not in ('error', 'signup') then event when k < 50 then 'old' end as lists,
  event = 'signup' as "signedOut", event = 'error' as stale from ev"""

ORACLE["preferred_tracks"] = """
select conv_id, turn from conversations where trim(text) <> '' qualify row_number() over (partition by conv_id order by (role = 'user')::int, turn) = 1"""

ORACLE["list_documents"] = f"""
with {_EVENTS} select ord, 1 as n_lists, case when event = 'error' then 0 else 2 end as n_items, 'Untitled' as name from ev"""
