"""The registered queries once more, as plain SQL over the given tables."""

from ticketscope.plans.bindings import COMMENT_ENDINGS

# --- fixed values, spelled out here once more so that a slip in the code's own lists shows as a difference ---
RESOLUTION_WORDS = ["resolved", "closed", "done", "fixed", "completed"]
REOPEN_WORDS = ["reopened", "in progress", "open", "todo", "to do", "in development"]
POSITIVE_PATTERNS = [
    "thank", "good", "great", "excellent", "awesome", "works", "working", "fixed", "resolved", "solved", "correct",
    "perfect", "nice", "love", "happy", "helpful", "appreciated", "appreciate",
]
NEGATIVE_PATTERNS = [
    "bug", "issue", "problem", "error", "fail", "failed", "wrong", "bad", "broken", "not work", "doesn't work",
    "incorrect", "crash", "stuck", "terrible", "horrible", "awful", "disappointing",
]
SENTIMENTS = ["Very Negative", "Negative", "Neutral", "Positive", "Very Positive"]
SENTIMENT_BOUNDS = [-0.6, -0.2, 0.2, 0.6]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _key(number: str) -> str:
    return f"concat('P', cast(({number} // 10) % 20 as varchar), '-', cast({number} as varchar))"


def _type(number: str) -> str:
    return f"case {number} % 4 when 0 then 'Task' when 1 then 'Improvement' else 'Bug' end"


def _any(column: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, {_quoted(word)})" for word in words) + ")"


def _present(column: str, words: list[str]) -> str:
    return " + ".join(f"cast(contains({column}, {_quoted(word)}) as int)" for word in words)


def _bucket(score: str) -> str:
    steps = " ".join(
        f"when cast({score} as double) <= cast({bound} as double) then {_quoted(label)}"
        for bound, label in zip(SENTIMENT_BOUNDS, SENTIMENTS)
    )
    return f"case {steps} else {_quoted(SENTIMENTS[-1])} end"


def _fraction(key: str, salt: str) -> str:
    return f"(cast(concat('0x', substring(md5(concat('{salt}', {key})), 1, 8)) as bigint) / 4294967296.0::double)"


def _shaped(time: str, shape: str) -> str:
    return f"""case {shape} when 1 then strftime({time}, '%Y-%m-%dT%H:%M:%S.000+0500')
        when 2 then strftime({time}, '%Y-%m-%d %H:%M') when 3 then strftime({time}, '%Y-%m-%d')
        when 4 then strftime({time}, '%Y-%m-%dT%H:%M:%S-03:00') when 5 then strftime({time}, '%Y-%m-%d %H:%M:%S.000000Z')
        else strftime({time}, '%Y-%m-%d %H:%M:%S') end"""


def _ahead(shape: str) -> str:
    return f"to_hours(case {shape} when 1 then 5 when 4 then -3 else 0 end)"


_EVENT_ISSUE = "(user_id * 10 + extract(day from ts) % 10)"
_SECONDS = "(floor(epoch({1})) - floor(epoch({0})))"
_ENDINGS = " ".join(f"when {n} then {_quoted(text)}" for n, text in COMMENT_ENDINGS.items())

# Views by name; each may use those above it.
_VIEWS = {
    "issues": f"""
        select {_key('o_orderkey')} as key, {_type('o_orderkey')} as issuetype_name, o_orderpriority as priority_name,
          case o_orderstatus when 'F' then 'Closed' when 'O' then 'Open' else 'In Progress' end as status_name,
          n_name as project_name, concat_ws(' ', c_mktsegment, 'order', o_orderpriority, 'from', n_name) as summary,
          o_orderdate as created, updated,
          case when o_orderstatus <> 'O' then updated end as resolutiondate, text as description
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
          left join (select l_orderkey, max(l_shipdate) as updated from lineitem group by 1) on o_orderkey = l_orderkey
          left join documents on o_orderkey = doc_id""",
    "changelog": f"""
        select event_id as id, {_key(_EVENT_ISSUE)} as key, ts as created,
          case event_id % 5 when 3 then 'Comment' when 4 then 'Attachment' else 'status' end as field,
          case event_id % 7 when 0 then 'Resolved' when 1 then 'CLOSED' when 2 then 'Open' when 3 then 'In Progress'
            when 4 then 'Done' when 5 then null else 'To Do' end as fromString,
          case event_type when 'view' then 'In Progress' when 'click' then 'Open' when 'purchase' then 'Resolved'
            when 'signup' then (case when event_id % 10 = 0 then 'Reopened' else 'To Do' end) else 'Closed' end as toString
        from events""",
    "comments": f"""
        select concat(cast(conv_id as varchar), '-', cast(turn as varchar)) as comment_id, {_key('conv_id')} as key,
          concat(text, case (conv_id * 3 + turn) % 7 {_ENDINGS} else '' end) as body
        from conversations""",
    "raw_issues": f"""
        select {_key('l_orderkey')} as key, {_type('l_orderkey')} as issuetype_name,
          case l_returnflag when 'A' then 'High' when 'N' then 'Low' end as priority_name,
          case l_linestatus when 'O' then 'Open' else concat('Closed, "done"', chr(10), 'for good') end as status_name,
          case when l_discount = 0.0 then strftime(l_shipdate - to_days(cast(l_quantity as int)), '%d-%m-%y')
            else {_shaped('(l_shipdate - to_days(cast(l_quantity as int)))', 'l_linenumber')} end as created,
          case when l_discount <> 0.0 then (l_shipdate - to_days(cast(l_quantity as int))) - {_ahead('l_linenumber')} end as created_at,
          strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as updated
        from lineitem""",
    "moves": f"""
        select *, lower(fromString) as source, lower(toString) as target from changelog
        where field = 'status' and fromString is not null and toString is not null""",
    "flags": f"""
        select key, bool_or(direct or (resolves and leaves)) as was_reopened from (
          select key, target = 'reopened' as direct, {_any('target', RESOLUTION_WORDS)} as resolves,
            coalesce(lead({_any('source', RESOLUTION_WORDS)} and {_any('target', REOPEN_WORDS)})
              over (partition by key order by created, id), false) as leaves
          from moves) group by key""",
    "bugs": """
        select issues.*, coalesce(was_reopened, false) as was_reopened
        from issues left join flags on issues.key = flags.key where issuetype_name = 'Bug'""",
    "activity": """
        select key, count(*) filter (where field = 'Comment') as comment_count,
          count(*) filter (where field = 'Attachment') as attachment_count,
          count(*) filter (where field = 'status') as status_change_count
        from changelog group by key""",
    "features": """
        select bugs.*, split_part(bugs.key, '-', 1) as project,
          coalesce(length(summary), 0)::bigint as summary_length,
          coalesce(length(description), 0)::bigint as description_length,
          coalesce(date_diff('day', created::date, resolutiondate::date), 0)::bigint as resolution_time_days,
          concat_ws(' ', coalesce(summary, ''), coalesce(description, '')) as text_content,
          coalesce(comment_count, 0) as comment_count, coalesce(attachment_count, 0) as attachment_count,
          coalesce(status_change_count, 0) as status_change_count
        from bugs left join activity on bugs.key = activity.key""",
    "cleaned": r"""
        select *, regexp_replace(regexp_replace(regexp_replace(lower(body), '<[^>]+>', '', 'g'),
          'http\S+', '', 'g'), '[^a-zA-Z\s]', ' ', 'g') as cleaned_text
        from comments""",
    "scored": f"""
        select *, {_bucket('sentiment_score')} as sentiment_category from (
          select *, cast(case when pos + neg = 0 then 0.0 else (pos - neg)::double / (pos + neg) end as float)
            as sentiment_score
          from (select *, {_present('cleaned_text', POSITIVE_PATTERNS)} as pos,
              {_present('cleaned_text', NEGATIVE_PATTERNS)} as neg
            from cleaned where length(cleaned_text) > 10))""",
    "by_issue": """
        select key, avg(sentiment_score::double) as avg_sentiment, count(*) as comment_count from scored group by key""",
    "resolved": f"""
        select *, {_SECONDS.format('created', 'resolutiondate')} / 3600.0::double as resolution_hours
        from issues where resolutiondate is not null""",
    "labelled": f"""
        select issuetype_name, priority_name, project_name, status_name, cast(resolution_hours > (
            select sum(cast(round(resolution_hours * 3600) as bigint)) / 3600.0::double / count(*)
            from resolved where {_fraction('key', 'split')} < 0.8) as int) as label
        from resolved where {_fraction('key', 'split')} < 0.8""",
    "pairs": "select quality::double as label, toxic::double as prediction from labels",
    "class_counts": """
        select label, (select count(*) from pairs x where x.label = c.label) as support,
          (select count(*) from pairs x where x.label = c.label and x.prediction = c.label) as tp,
          (select count(*) from pairs x where x.prediction = c.label) as predicted
        from (select distinct label from pairs) c""",
    "class_rates": """
        select label, support, tp, precision, recall,
          case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1
        from (select *, case when predicted > 0 then tp::double / predicted else 0.0 end as precision,
          tp::double / support as recall from class_counts)""",
    "clusters": """
        select project_name as prediction, count(*) as total_bugs,
          count(*) filter (where was_reopened) as reopened_bugs,
          count(*) filter (where was_reopened)::double / count(*) as reopening_rate,
          avg(comment_count) as avg_comments, avg(attachment_count) as avg_attachments,
          avg(summary_length) as avg_summary_length, avg(description_length) as avg_description_length,
          avg(status_change_count) as avg_status_changes
        from features group by project_name""",
    "recent": f"""
        select *, round({_SECONDS.format('created', 'updated')} / 86400, 2) as resolution_days
        from issues where updated is not null
          and created >= (select (max(created)::date - interval 24 month)::date from issues)""",
}

_NEEDS = {
    "moves": ["changelog"], "flags": ["moves"], "bugs": ["issues", "flags"], "activity": ["changelog"],
    "features": ["bugs", "activity"], "cleaned": ["comments"], "scored": ["cleaned"], "by_issue": ["scored"],
    "resolved": ["issues"], "labelled": ["resolved"], "class_counts": ["pairs"], "class_rates": ["class_counts"], "clusters": ["features"],
    "recent": ["issues"],
}


def _with(views: list[str], body: str) -> str:
    wanted: list[str] = []

    def add(view: str) -> None:
        for needed in _NEEDS.get(view, []):
            add(needed)
        if view not in wanted:
            wanted.append(view)

    for view in views:
        add(view)
    if not wanted:
        return body
    return "with " + ",\n".join(f"{view} as ({_VIEWS[view]})" for view in wanted) + "\n" + body


_CLEAN_ISSUES = _with(["raw_issues"], """
    select key, issuetype_name, priority_name, status_name, created_at as created, try_strptime(updated, '%Y-%m-%d %H:%M:%S') as updated
    from (select *, row_number() over (partition by key order by updated desc, issuetype_name desc nulls last,
        priority_name desc nulls last, status_name desc nulls last, created desc nulls last) as n from raw_issues)
    where n = 1 and priority_name is not null and created like '20%' and updated like '20%'""")


def oracle_sql() -> dict[str, str]:
    """SQL per registered query whose result SQL can express."""
    return {
        "bug_share": _with(["issues"], """
            select count(*) as issue_count, count(*) filter (where issuetype_name = 'Bug') as bug_count,
              count(*) filter (where issuetype_name = 'Bug') * 100.0::double / count(*) as bug_percent from issues"""),
        "issue_profile": _with(["issues"], """
            select count(*) as row_count, count(key) as key_present, count(issuetype_name) as issuetype_name_present,
              count(priority_name) as priority_name_present, count(status_name) as status_name_present,
              count(project_name) as project_name_present, count(summary) as summary_present,
              count(created) as created_present, count(updated) as updated_present,
              count(resolutiondate) as resolutiondate_present, count(description) as description_present
            from issues"""),
        "clean_issues": _CLEAN_ISSUES,
        "csv_issues": _CLEAN_ISSUES,
        "ingested_issues": _CLEAN_ISSUES,
        "activity_report_fields": f"""
            select event_type as field, count(*) as total_changes, count(distinct {_key(_EVENT_ISSUE)}) as affected_issues
            from events where event_type <> 'error' group by 1 order by 2 desc, 1 limit 10""",
        "offset_hours": _with(["issues"], f"""
            select key, ({_SECONDS.format('created', 'resolutiondate')} / 3600.0::double)
              + (case n % 6 when 1 then 5 when 4 then -3 else 0 end) - (case (n // 6) % 6 when 1 then 5 when 4 then -3 else 0 end)
              as resolution_hours
            from (select *, cast(split_part(key, '-', 2) as bigint) as n from issues where resolutiondate is not null)"""),
        "balanced_after_sample": _with(["bugs"], f"""
            select key, was_reopened from bugs where {_fraction('key', 'issues')} < 0.3 and (was_reopened
              or {_fraction('key', 'balance')} < (
                select count(*) filter (where was_reopened) * 3.0::double / count(*) filter (where not was_reopened)
                from bugs where {_fraction('key', 'issues')} < 0.3))"""),
        "features_without_changelog": _with(["issues"], """
            select key, false as was_reopened, coalesce(length(summary), 0)::bigint as summary_length,
              coalesce(length(description), 0)::bigint as description_length, 0::bigint as comment_count,
              0::bigint as status_change_count
            from issues where issuetype_name = 'Bug'"""),
        "topic_weight_totals": _with(["scored"], "select comment_id, 1.0::double as total from scored"),
        "region_terms": """
            select n_regionkey::int as topic, string_agg(n_name, '|' order by n_nationkey) as words,
              sum(n_nationkey)::double as weight
            from nation group by 1""",
        "saved_cluster_counts": _with(["clusters"], "select prediction, total_bugs as count from clusters"),
        "published_reports": _with(["clusters", "class_rates"], """
            select 'cluster_counts' as report, prediction as item, total_bugs::double as value from clusters
            union all select 'cluster_reopening_rates', prediction, round(reopening_rate, 6) from clusters
            union all select 'reopening_model_metrics', label::int::varchar, support::double from class_rates"""),
        "kmeans_total": _with(["bugs"], "select count(*) as bugs, 4::bigint as clusters from bugs"),
        "slow_confusion_totals": _with(["resolved"], f"""
            select m as Model, (select count(*) from resolved where not {_fraction('key', 'split')} < 0.8) as rows
            from (select unnest(['RandomForest', 'GBT', 'LogReg', 'DecisionTree']) as m)"""),
        "folded_counts": _with(["resolved"], f"""
            select issuetype_name, priority_name, project_name, status_name, cast(resolution_hours > (
                select sum(cast(round(resolution_hours * 3600) as bigint)) / 3600.0::double / count(*)
                from resolved where {_fraction('key', 'split')} < 0.8) as int) as label,
              cast(floor({_fraction('key', 'fold')} * 3) as bigint) as fold, {_fraction('key', 'held out')} < 0.2 as held_out,
              count(*)::double as weight
            from resolved where {_fraction('key', 'split')} < 0.8 group by all"""),
        "comment_sample_exact": _with(["comments"], """
            select comment_id from comments order by md5(concat('size', comment_id)) limit 300"""),
        "slow_regression_balance": _with(["labelled"], """
            select source, value, count(*) as rows, sum(label)::bigint as positives
            from labelled cross join lateral (values ('issuetype_name', issuetype_name), ('priority_name', priority_name),
              ('project_name', project_name), ('status_name', status_name)) as v(source, value)
            group by all"""),
        "priority_coefficients": _with(["labelled"], """
            select concat('priority_name=', priority_name) as feature, round(w - avg(w) over (), 4) as weight
            from (select priority_name, ln(avg(label) / (1 - avg(label))) as w from labelled group by 1)"""),
        "slow_tree_root": _with(["labelled"], """
            select * from (with sides as (
              select source, value, count(*)::double as n, sum(label)::double as ones
              from labelled cross join lateral (values ('issuetype_name', issuetype_name), ('priority_name', priority_name),
                ('project_name', project_name), ('status_name', status_name)) as v(source, value)
              group by all),
            whole as (select count(*)::double as n, sum(label)::double as ones from labelled),
            gains as (
              select source, value, 2 * w.ones / w.n * (1 - w.ones / w.n) - s.n / w.n * 2 * s.ones / s.n * (1 - s.ones / s.n)
                - (w.n - s.n) / w.n * 2 * (w.ones - s.ones) / (w.n - s.n) * (1 - (w.ones - s.ones) / (w.n - s.n)) as gain
              from sides s, whole w where s.n < w.n)
            select source, value, round(gain, 6) as gain from gains order by gains.gain desc limit 1)"""),
        "slow_tree_leaves": "select true as grown, 0::bigint as wrong_leaves",
        "pca_certificate": "select unnest([1, 2])::int as component, 0::bigint as violations",
        "kmeans_certificate": "select 4::bigint as clusters, count(*) as rows, 0::bigint as wrong_rows, 0::bigint as wrong_slots from embeddings",
        "nearest_silhouette": """
            with points as (select row_number() over () as r, label, embedding::double[] as x from embeddings),
            sums as (select label, i, avg(v) as v from (select label, unnest(x) as v, unnest(range(len(x))) as i from points) group by 1, 2),
            means as (select row_number() over (order by label) as c, list(v order by i) as y from sums group by label),
            sets as (select unnest([2, 3, 4])::bigint as k),
            placed as (
              select k, r, any_value(x) as x, min({'d': list_dot_product(y, y) - 2 * list_dot_product(x, y), 'c': c}).c as label
              from sets, points, means where c <= k group by k, r),
            squares as (select *, list_dot_product(x, x) as s from placed),
            parts as (select k, label, i, sum(v) as v from (select k, label, unnest(x) as v, unnest(range(len(x))) as i from placed) group by all),
            groups as (select k, label, list(v order by i) as y from parts group by all),
            sizes as (select k, label, count(*) as n, sum(s) as s from squares group by all),
            apart as (
              select p.k, p.r, p.label, g.label as other, z.n, p.s + z.s / z.n - 2 * list_dot_product(p.x, g.y) / z.n as d
              from squares p join groups g on p.k = g.k join sizes z on g.k = z.k and g.label = z.label),
            sides as (
              select k, r, max(d * n / nullif(n - 1, 0)) filter (where label = other) as a, max(n) filter (where label = other) as n,
                min(d) filter (where label <> other) as b from apart group by all)
            select k, round(avg(case when n = 1 then 0.0 else (b - a) / greatest(a, b) end), 6) as silhouette from sides group by k""",
        "indexed_projects": _with(["issues"], """
            select project_name, (row_number() over (order by n desc, project_name) - 1)::double as index
            from (select project_name, count(*) as n from issues group by 1)"""),
        "scored_auc": """
            with s as (select quality as label, doc_id % 10 + toxic * 3 as score, count(*) as n from labels group by all)
            select round(sum(case when p.score > q.score then p.n * q.n when p.score = q.score then 0.5 * p.n * q.n else 0 end)::double
              / ((select sum(n) from s where label = 1) * (select sum(n) from s where label = 0)), 9) as auc
            from s p join s q on p.label = 1 and q.label = 0""",
        "embedding_silhouette": """
            with points as (select row_number() over () as r, label, embedding::double[] as x from embeddings),
            squares as (select r, label, x, list_dot_product(x, x) as s from points),
            sums as (select label, i, sum(v) as v from (select label, unnest(x) as v, unnest(range(len(x))) as i from points) group by 1, 2),
            groups as (select label, list(v order by i) as y from sums group by 1),
            sizes as (select label, count(*) as n, sum(s) as s from squares group by 1),
            apart as (
              select p.r, p.label, g.label as other, z.n, p.s + z.s / z.n - 2 * list_dot_product(p.x, g.y) / z.n as d
              from squares p, groups g join sizes z on g.label = z.label),
            sides as (
              select r, max(d * n / nullif(n - 1, 0)) filter (where label = other) as a, max(n) filter (where label = other) as n,
                min(d) filter (where label <> other) as b from apart group by r)
            select round(avg(case when n = 1 then 0.0 else (b - a) / greatest(a, b) end), 6) as silhouette from sides""",
        "comment_study": _with(["by_issue", "issues"], f"""
            select {_bucket('avg_sentiment')} as sentiment_bucket, count(*) as issue_count,
              avg(days) as avg_resolution_days, min(days)::int as min_resolution_days, max(days)::int as max_resolution_days
            from by_issue join (select key, date_diff('day', created::date, resolutiondate::date) as days from issues) i
              on by_issue.key = i.key
            where days >= 0 group by 1"""),
        "clean_comments": f"""
            select comment_id, key, comment_body from (
              select *, row_number() over (partition by comment_id
                order by key desc nulls last, comment_body desc nulls last) as n
              from (select concat(cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar)) as comment_id,
                  case when l_returnflag <> 'R' then {_key('l_orderkey')} end as key,
                  concat(cast(l_partkey as varchar), ' ', cast(l_suppkey as varchar)) as comment_body from lineitem))
            where n = 1 and key is not null""",
        "clean_changelog": f"""
            select event_id as id, {_key(_EVENT_ISSUE)} as key, event_type as field, concat('later ', props) as toString,
              ts + interval 1 day as created
            from events where event_type <> 'error'""",
        "enriched_issues": _with(["issues", "comments", "activity"], """
            select issues.key, coalesce(c.n, 0) as comment_count,
              coalesce(activity.status_change_count, 0) as status_change_count
            from issues left join (select key, count(*) as n from comments group by key) c on issues.key = c.key
              left join activity on issues.key = activity.key"""),
        "recent_resolution": _with(["recent"], """
            select key, created, updated, resolution_days, project_name, status_name, priority_name, issuetype_name
            from recent"""),
        "resolution_by_priority_status": _with(["recent"], """
            select priority_name, status_name,
              sum(resolution_days::decimal(18,2))::double / count(*) as avg_resolution_days
            from recent group by 1, 2"""),
        "top_changed_fields": f"""
            select props as field, count(*) as total_changes, count(distinct {_key(_EVENT_ISSUE)}) as affected_issues
            from events group by 1 order by 2 desc, 1 limit 10""",
        "sampled_bug_changes": _with(["issues", "changelog"], f"""
            select id, key, field from changelog where key in (
              select key from issues where issuetype_name = 'Bug' and {_fraction('key', 'issues')} < 0.3)"""),
        "reopen_flags": _with(["flags"], "select key, was_reopened from flags"),
        "reopen_flags_segmented": _with(["flags"], "select key, was_reopened from flags"),
        "flagged_bugs": _with(["bugs"], "select key, was_reopened from bugs"),
        "reopen_share": _with(["bugs"], """
            select count(*) as total_bugs, count(*) filter (where was_reopened) as reopened_bugs,
              count(*) filter (where was_reopened) * 100.0::double / count(*) as reopened_percent from bugs"""),
        "reopen_examples": _with(["bugs"], """
            select key, summary, priority_name, status_name from bugs where was_reopened order by key limit 5"""),
        "reopen_features": _with(["features"], """
            select key, was_reopened, project, priority_name, summary_length, description_length, resolution_time_days,
              comment_count, attachment_count, status_change_count, md5(text_content) as text_md5 from features"""),
        "reopen_profile": _with(["features"], """
            select was_reopened, count(*) as bug_count, avg(comment_count) as avg_comments,
              avg(summary_length) as avg_summary_length, avg(description_length) as avg_description_length,
              avg(attachment_count) as avg_attachments, avg(status_change_count) as avg_status_changes,
              avg(resolution_time_days) as avg_resolution_days
            from features group by was_reopened"""),
        "reopen_profile_strict": _with(["features", "moves"], """
            select was_reopened, count(*) as bug_count, avg(comment_count) as avg_comments,
              avg(summary_length) as avg_summary_length, avg(description_length) as avg_description_length,
              avg(attachment_count) as avg_attachments, avg(coalesce(m.n, 0)) as avg_status_changes,
              avg(date_diff('day', created::date, resolutiondate::date)) as avg_resolution_days
            from features left join (select key, count(*) as n from moves group by key) m on features.key = m.key
            group by was_reopened"""),
        "balanced_sample": _with(["bugs"], f"""
            select key, was_reopened from bugs where was_reopened or {_fraction('key', 'balance')} < (
              select count(*) filter (where was_reopened) * 3.0::double / count(*) filter (where not was_reopened)
              from bugs)"""),
        "train_test_split": _with(["bugs"], f"""
            select key, {_fraction('key', 'split')} < 0.8 as in_train from bugs"""),
        "comment_sample": _with(["comments"], f"""
            select comment_id from comments where {_fraction('comment_id', 'size')} < 300.0::double / (select count(*) from comments)"""),
        "cleaned_comments": _with(["cleaned"], """
            select comment_id, key, cleaned_text from cleaned where length(cleaned_text) > 10"""),
        "comment_sentiment": _with(["scored"], "select comment_id, sentiment_score, sentiment_category from scored"),
        "sentiment_distribution": _with(["scored"], "select sentiment_category, count(*) as count from scored group by 1"),
        "sentiment_examples": _with(["scored"], """
            select sentiment_category, comment_id, sentiment_score, example::int as example,
              case when length(body) > 100 then concat(substring(body, 1, 97), '...') else body end as text
            from (select *, row_number() over (partition by sentiment_category order by comment_id) as example from scored)
            where example <= 2"""),
        "sentiment_by_issue": _with(["by_issue"], """
            select key, round(avg_sentiment, 6) as avg_sentiment, comment_count from by_issue"""),
        "sentiment_vs_resolution": _with(["by_issue", "issues"], f"""
            select {_bucket('avg_sentiment')} as sentiment_bucket, count(*) as issue_count,
              avg(days) as avg_resolution_days, min(days)::int as min_resolution_days, max(days)::int as max_resolution_days
            from by_issue join (select key, date_diff('day', created::date, resolutiondate::date) as days from issues) i
              on by_issue.key = i.key
            where days >= 0 group by 1"""),
        "cluster_counts": _with(["clusters"], "select prediction, total_bugs as count from clusters"),
        "cluster_keywords": r"""
            select prediction, word, count, rank from (
              select *, rank() over (partition by prediction order by count desc) as rank from (
                select lang as prediction, word, count(*) as count
                from (select lang, unnest(regexp_split_to_array(lower(text), '\s+')) as word from documents)
                where word <> '' group by 1, 2))
            where rank <= 10""",
        "cluster_examples": _with(["bugs"], """
            select prediction, key, summary, example::int as example from (
              select project_name as prediction, key, summary,
                row_number() over (partition by project_name order by key) as example from bugs)
            where example <= 3"""),
        "cluster_reopening_rates": _with(["clusters"], """
            select prediction, total_bugs, reopened_bugs, reopening_rate from clusters"""),
        "cluster_extremes": _with(["clusters"], """
            (select 'highest' as extreme, prediction, reopening_rate, avg_comments, avg_attachments, avg_summary_length,
              avg_description_length, avg_status_changes from clusters order by reopening_rate desc, prediction limit 1)
            union all
            (select 'lowest' as extreme, prediction, reopening_rate, avg_comments, avg_attachments, avg_summary_length,
              avg_description_length, avg_status_changes from clusters order by reopening_rate, prediction limit 1)"""),
        "class_metrics": _with(["class_rates"], "select label, support, tp, precision, recall, f1 from class_rates"),
        "classification_report": _with(["class_rates"], """
            select sum(tp)::double / sum(support) as accuracy,
              round(sum(precision * support) / sum(support), 9) as weighted_precision,
              round(sum(recall * support) / sum(support), 9) as weighted_recall,
              round(sum(f1 * support) / sum(support), 9) as weighted_f1 from class_rates"""),
        "confusion_table": """
            select source as Model, count(*) filter (where toxic = 1 and quality = 1) as TP,
              count(*) filter (where toxic = 1 and quality = 0) as FP,
              count(*) filter (where toxic = 0 and quality = 0) as TN,
              count(*) filter (where toxic = 0 and quality = 1) as FN
            from labels join documents using (doc_id) group by 1""",
        "topic_weights_by_label": "select label, " + ", ".join(
            f"round(avg(embedding[{i + 1}]::double), 6) as avg_topic_{i}" for i in range(64)
        ) + " from embeddings group by label",
        "slow_labels": _with(["resolved"], f"""
            select key, resolution_hours, cast(resolution_hours > (
              select sum(cast(round(resolution_hours * 3600) as bigint)) / 3600.0::double / count(*) from resolved)
              as int) as label
            from resolved"""),
        "permuted_values": _with(["issues"], """
            select project_name as value, count(*) as original, count(*) as permuted from issues group by 1"""),
    }
