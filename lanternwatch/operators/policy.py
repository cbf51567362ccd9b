"""Risk, roles, rules and decisions over tables of tool calls.

A rule is a function of columns to a struct(action, risk, reason, rule) or
null; ``decide`` takes the first stage that speaks, by ``coalesce``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternwatch.functions.regexes import ODD_LETTERS, Pattern, hinted
from lanternwatch.operators import injection, pii
from lanternwatch.streaming.shared import settled

# Risk class of known tools.
RISK_OVERRIDES = {
    "read_email": "READ_ONLY", "list_emails": "READ_ONLY", "search_email": "READ_ONLY", "draft_email": "WRITE", "create_draft": "WRITE", "send_email": "EXTERNAL_SIDE_EFFECT",
    "send_draft": "EXTERNAL_SIDE_EFFECT", "gmail.read_email": "READ_ONLY", "gmail.list_messages": "READ_ONLY", "gmail.send_email": "EXTERNAL_SIDE_EFFECT",
    "github.create_issue": "EXTERNAL_SIDE_EFFECT", "github.create_pr_comment": "EXTERNAL_SIDE_EFFECT", "github.merge_pr": "DESTRUCTIVE", "github.delete_branch": "DESTRUCTIVE",
    "supabase.query": "WRITE", "postgres.query": "WRITE", "filesystem.read": "READ_ONLY", "filesystem.write": "WRITE", "filesystem.delete": "DESTRUCTIVE", "shell.run": "EXTERNAL_SIDE_EFFECT",
    "browser.fetch": "READ_ONLY", "browser.click": "WRITE", "browser.submit": "EXTERNAL_SIDE_EFFECT", "social.create_draft": "WRITE", "social.publish": "EXTERNAL_SIDE_EFFECT",
    "social.publish_with_approval": "EXTERNAL_SIDE_EFFECT", "gdrive.read": "READ_ONLY", "gdrive.upload": "WRITE", "slack.send_message": "EXTERNAL_SIDE_EFFECT", "sms.send": "EXTERNAL_SIDE_EFFECT",
    "http.fetch": "READ_ONLY", "http.post": "EXTERNAL_SIDE_EFFECT", "submit_payment": "DESTRUCTIVE", "initiate_transfer": "DESTRUCTIVE", "void_payment": "DESTRUCTIVE",
}
# Words in tool names, most severe class first.
RISK_WORDS = (
    ("DESTRUCTIVE", "delete|destroy|purge|drop|payment|transfer|revoke"),
    ("EXTERNAL_SIDE_EFFECT", "send|submit|publish|webhook|notify"),
    ("WRITE", "create|update|write|set|add|insert|modify|edit|navigate|fill"),
)
RISK_LEVEL = {"READ_ONLY": "LOW", "WRITE": "MEDIUM", "EXTERNAL_SIDE_EFFECT": "HIGH", "DESTRUCTIVE": "CRITICAL"}
LEVELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
# Roles by rank, what they may run, and the role that may approve each level.
ROLES = ("EXTERNAL_AUDITOR", "END_USER", "REVIEWER", "OPERATOR", "TENANT_ADMIN")
MAY_RUN = {"END_USER": "r", "REVIEWER": "r", "OPERATOR": "rw", "TENANT_ADMIN": "rwd"}
NEEDS = {"READ_ONLY": "r", "WRITE": "w", "EXTERNAL_SIDE_EFFECT": "d", "DESTRUCTIVE": "d"}
APPROVER = {"LOW": "END_USER", "MEDIUM": "REVIEWER", "HIGH": "OPERATOR", "CRITICAL": "TENANT_ADMIN"}
# Tools that carry data out.
SENSITIVE_SINKS = ("gmail.send_email", "slack.send_message", "sms.send", "webhook.send", "http.post", "social.publish_with_approval", "github.create_issue", "github.create_pr_comment", "postgres.query", "supabase.query")
CORPORATE_DOMAINS, DENYLIST, SANDBOX = ("corp.example.com",), ("bad.example.net",), "/srv/sandbox"


def lookup(key: Column, values: dict) -> Column:
    """A small fixed table as a literal map; it needs no join."""
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))]), key)


def risk_class(tool: Column, declared: Column | None = None) -> Column:
    """The published class of a known tool, else the one it declares itself (null: none), else by the words in its name."""
    lower = F.lower(tool)
    ladder = F.coalesce(*[F.when(lower.rlike(words), c) for c, words in RISK_WORDS], F.lit("READ_ONLY"))
    return F.coalesce(lookup(lower, RISK_OVERRIDES), *([] if declared is None else [declared]), ladder)


def risk_level(tool: Column) -> Column:
    return lookup(risk_class(tool), RISK_LEVEL)


def level_rank(level: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in LEVELS]), level)


def requires_approval(tool: Column, threshold: str = "HIGH", explicit: Column | None = None) -> Column:
    """An explicit flag wins over the level of the tool."""
    by_level = level_rank(risk_level(tool)) >= LEVELS.index(threshold) + 1
    return by_level if explicit is None else F.coalesce(explicit, by_level)


def may_execute(role: Column, tool: Column) -> Column:
    return F.coalesce(lookup(role, MAY_RUN).contains(lookup(risk_class(tool), NEEDS)), F.lit(False))


def may_approve(role: Column, level: Column) -> Column:
    ranks = {r: i for i, r in enumerate(ROLES)}
    return F.coalesce(lookup(role, ranks) >= lookup(lookup(level, APPROVER), ranks), F.lit(False))


def trust_label(tool: Column) -> Column:
    lower = F.lower(tool)
    reads_mail = lower.contains("read") & (lower.contains("email") | lower.contains("message"))
    return F.when(lower.startswith("browser.") | lower.startswith("http.fetch") | reads_mail | lower.startswith("filesystem.read"), "UNTRUSTED").otherwise("INTERNAL")


def sensitive_sink(tool: Column) -> Column:
    return tool.isin(*SENSITIVE_SINKS)


def arg(args: Column, *names: str) -> Column:
    """First of the named top-level arguments that is there."""
    return F.coalesce(*[F.get_json_object(args, f"$.{n}") for n in names])


@dataclass(frozen=True)
class Rule:
    """``evaluate(tool, args)`` gives struct(action, risk, reason, rule) or null."""

    name: str
    evaluate: Callable[[Column, Column], Column]


def outcome(action: str, risk: str, reason: Column | str, rule: str) -> Column:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(F.lit(action).alias("action"), F.lit(risk).alias("risk"), reason.alias("reason"), F.lit(rule).alias("rule"))


def first_reason(text: Column, patterns: Sequence[Pattern]) -> Column:
    return F.coalesce(*[F.when(p.found(text), p.name) for p in patterns])


# Commands, statements and paths.
SHELL = [
    Pattern("rm -rf on root, home, or wildcards", r"\brm\s+-rf\s+(?:/|~|\$HOME|\*)", "i"),
    Pattern("Filesystem format command", r"\bmkfs\b", "i"),
    Pattern("dd disk overwrite", r"\bdd\s+if=", "i"),
    Pattern("Fork bomb", r":\(\)\s*\{\s*:\s*\|\s*:\s*&\s*\}\s*;\s*:"),
    Pattern("Recursive 777 on root", r"\bchmod\s+-R\s+777\s+/", "i"),
    Pattern("Recursive chown on root", r"\bchown\s+-R\s+\w+\s+/", "i"),
    Pattern("Pipe download to shell", r"\b(?:wget|curl)\s+[^|]*\|\s*(?:bash|sh|zsh|fish)\b", "i"),
    Pattern("System shutdown", r"\bshutdown\s+-h\b|\binit\s+0\b|\bpoweroff\b|\bhalt\b", "i"),
    Pattern("System reboot", r"\breboot\b", "i"),
    Pattern("Password change", r"\b(sudo\s+)?passwd\b", "i"),
    Pattern("Flush all firewall rules", r"\biptables\s+-F\b", "i"),
    Pattern("Partition table modification", r"\bfdisk\s+/dev/", "i"),
    Pattern("Remove all cron jobs", r"\bcrontab\s+-r\b", "i"),
    Pattern("User account management", r"\b(useradd|userdel|adduser|deluser)\b", "i"),
    Pattern("Netcat listener (potential reverse shell)", r"\bnc\s+-l\b", "i"),
    Pattern("Sensitive system file access", r"\b/etc/(passwd|shadow|sudoers)\b", "i"),
]
SQL_HARD = [
    Pattern("DROP statement", r"\bdrop\s+(?:table|database|schema|user|role|index)\b", "i"),
    Pattern("TRUNCATE statement", r"\btruncate\s+(?:table\s+)?\w+", "i"),
    Pattern("ALTER USER privilege change", r"\balter\s+user\s+\w+\s+(?:with\s+)?(?:password|superuser)", "i"),
    Pattern("GRANT ALL PRIVILEGES", r"\bgrant\s+all\s+privileges\b", "i"),
    Pattern("REVOKE ALL", r"\brevoke\s+all\b", "i"),
]
WHERE = Pattern("where", r"\bwhere\b", "i")
DELETE = Pattern("DELETE without WHERE clause", r"\bdelete\s+from\s+\w+", "i")
UPDATE = Pattern("UPDATE without WHERE clause", r"\bupdate\s+\w+\s+set\s+", "i")
CREATE_USER = Pattern("CREATE USER/ROLE", r"\bcreate\s+(?:user|role)\b", "i")
PROD = Pattern("production", r"\b(prod|production|live)\b", "i")
PATHS = [
    Pattern("system settings", r"^/etc/", "i"), Pattern("logs", r"^/var/log/", "i"), Pattern("root home", r"^/root/", "i"), Pattern("kernel", r"^/sys/", "i"), Pattern("processes", r"^/proc/", "i"),
    Pattern("windows system", r"^[A-Z]:\\Windows\\System32\\", "i"), Pattern("ssh keys", r"\.ssh[/\\]", "i"), Pattern("cloud credentials", r"\.aws[/\\]credentials", "i"), Pattern("repository settings", r"\.git[/\\]config", "i"),
]
DEPLOY_WORDS = "deploy|release|rollout|publish|merge_pr|production|prod"
PAYMENT_WORDS = "payment|payout|transfer|charge|refund|invoice|stripe|paypal|razorpay"
PUBLISH_WORDS = r"social\.publish|twitter\.post|linkedin\.post|facebook\.post|instagram\.post|social_post"
BAD_SCHEME = "(?i)^(file|chrome|chrome-extension|view-source|javascript):"


def _shell(tool: Column, args: Column) -> Column:
    command = F.coalesce(arg(args, "command", "cmd", "script", "shell", "args"), args)
    reason = first_reason(command, SHELL)
    return F.when(F.lower(tool).rlike("shell|exec|run") & reason.isNotNull(), outcome("BLOCK", "CRITICAL", reason, "dangerous-shell"))


def _sql(tool: Column, args: Column) -> Column:
    sql = arg(args, "sql", "query", "statement", "q")
    is_sql = F.lower(tool).rlike("sql|query|postgres|supabase|database")
    hard = first_reason(sql, SQL_HARD)
    open_where = ~WHERE.found(sql)
    soft = F.coalesce(F.when(DELETE.found(sql) & open_where, DELETE.name), F.when(UPDATE.found(sql) & open_where, UPDATE.name), F.when(CREATE_USER.found(sql), CREATE_USER.name))
    return F.when(is_sql & hard.isNotNull(), outcome("BLOCK", "CRITICAL", hard, "dangerous-sql")).when(is_sql & soft.isNotNull(), outcome("REQUIRES_APPROVAL", "HIGH", soft, "dangerous-sql"))


def external_recipients(args: Column, domains: Sequence[str] = CORPORATE_DOMAINS) -> Column:
    listed = F.concat_ws(",", *[F.get_json_object(args, f"$.{n}") for n in ("to", "recipient", "recipients", "cc", "bcc")])
    each = F.filter(F.transform(F.split(listed, "[,;]"), lambda x: F.trim(x)), lambda x: x.contains("@"))
    domain = lambda x: F.lower(F.substring_index(x, "@", -1))
    inside = lambda d: F.greatest(*[(d == c) | d.endswith("." + c) for c in domains], F.lit(False))
    return F.filter(each, lambda x: ~inside(domain(x)))


def _email(tool: Column, args: Column, holds: Column | None = None) -> Column:
    """``holds``: whether the mail's text has personal data, where that is known and the text is not in ``args``."""
    lower = F.lower(tool)
    mails = lower.rlike(r"(^|[_.])(send_email|gmail\.send_email|send_draft|mail\.send)$") | (lower.contains("send") & lower.contains("email"))
    body = F.concat_ws("\n", *[F.get_json_object(args, f"$.{n}") for n in ("subject", "body", "message", "text", "html")])
    personal = F.size(pii.types_v1(body)) > 0 if holds is None else holds
    return F.when(mails & (F.size(external_recipients(args)) > 0) & personal, outcome("REQUIRES_APPROVAL", "HIGH", "personal data to an external recipient", "external-email-pii"))


def _deploy(tool: Column, args: Column) -> Column:
    lower, env = F.lower(tool), arg(args, "environment", "env", "target")
    prod = F.coalesce(PROD.found(env), F.lit(False))
    named = Pattern("", r"production|prod\b|live").found(lower)
    return F.when((lower.rlike(DEPLOY_WORDS) | prod) & (prod | named), outcome("REQUIRES_APPROVAL", "CRITICAL", "production deployment", "production-deploy"))


def _payment(tool: Column, args: Column) -> Column:
    return F.when(F.lower(tool).rlike(PAYMENT_WORDS), outcome("REQUIRES_APPROVAL", "CRITICAL", "financial action", "payment"))


def _social(tool: Column, args: Column) -> Column:
    lower = F.lower(tool)
    return F.when(lower.rlike(PUBLISH_WORDS) & ~lower.contains("draft"), outcome("REQUIRES_APPROVAL", "HIGH", "public post", "social-publish"))


def normal_path(path: Column) -> Column:
    """Absolute path with ``.`` and ``..`` resolved."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    walk = lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), walk), "/"))


def _filesystem(tool: Column, args: Column) -> Column:
    lower, path = F.lower(tool), arg(args, "path", "file", "filepath", "filename")
    fs = lower.startswith("filesystem.") | lower.startswith("fs.") | lower.contains("file_") | lower.isin("read_file", "write_file", "delete_file")
    bad = F.coalesce(*[F.when(p.found(path), p.name) for p in PATHS])
    real = normal_path(path)
    outside = path.startswith("/") & (real != SANDBOX) & ~real.startswith(SANDBOX + "/")
    return F.when(fs & bad.isNotNull(), outcome("BLOCK", "CRITICAL", bad, "filesystem-sandbox")).when(fs & outside, outcome("REQUIRES_APPROVAL", "HIGH", "outside the sandbox", "filesystem-sandbox"))


def _browser(tool: Column, args: Column) -> Column:
    lower, url = F.lower(tool), arg(args, "url", "href", "target")
    web = (lower.startswith("browser.") | lower.startswith("http.") | (lower == "fetch_url")) & url.isNotNull()
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1))
    denied = F.greatest(*[(host == h) | host.endswith("." + h) for h in DENYLIST], F.lit(False))
    return (
        F.when(web & url.rlike(BAD_SCHEME), outcome("BLOCK", "HIGH", "disallowed scheme", "browser-scrape"))
        .when(web & (host == ""), outcome("BLOCK", "MEDIUM", "invalid address", "browser-scrape"))
        .when(web & denied, outcome("BLOCK", "HIGH", "host on the denylist", "browser-scrape"))
    )


RULES = [Rule("dangerous-shell", _shell), Rule("dangerous-sql", _sql), Rule("external-email-pii", _email), Rule("production-deploy", _deploy), Rule("payment", _payment), Rule("social-publish", _social), Rule("filesystem-sandbox", _filesystem), Rule("browser-scrape", _browser)]


def apply_rules(calls: DataFrame, rules: Sequence[Rule] = tuple(RULES)) -> DataFrame:
    """Every rule that speaks on a call: ``request_id, tool_name, action, risk, reason, rule``."""
    said = F.array_compact(F.array(*[r.evaluate(F.col("tool_name"), F.col("args")) for r in rules]))
    return calls.select("request_id", "tool_name", F.explode(said).alias("o")).select("request_id", "tool_name", "o.*")


STAGES = ("hard_rule", "injection", "offensive", "taint", "chain", "soft_rule", "pii", "anomaly", "rbac", "threshold")


def _once(df: DataFrame, column: Column, name: str) -> DataFrame:
    """Exploding an array of one keeps later filters from copying the expressions below them."""
    return df.select("*", F.explode(F.array(column)).alias(name))


def scan_texts(rows: DataFrame, text: str, personal: bool = True, mailed: bool = False) -> DataFrame:
    """Adds what decisions need to know of a text: ``_pii`` where ``personal``, ``_mailed`` where asked for (whether a mail with it has personal data), ``_injected`` (at high risk) and ``_offensive``.

    One pass of joined patterns passes over texts in which nothing can be found; only the others are scanned in full.
    """
    body = F.col(text)
    rows = rows.withColumn("_may", hinted(body, {"pii": pii.hints(), "direct": injection.hints(), "sure": injection.sure_signs(), "hidden": injection.HIDDEN, "offensive": injection.offensive_hints(), "other": [injection.UNSTEADY]}))
    rows = rows.withColumn("_plain", F.coalesce(injection.canonical(F.when(F.col("_may.other"), body)), body))
    rows = rows.withColumn("_may_plain", hinted(F.when(body != F.col("_plain"), F.col("_plain")), {"plain": injection.standard_hints()}))
    # one operator each, so that none grows beyond what is compiled
    if mailed:
        rows = _once(rows, F.when(F.col("_may.pii"), F.size(pii.types_v1(body)) > 0).otherwise(False), "_mailed")
    if personal:
        rows = _once(rows, F.when(F.col("_may.pii"), pii.holds_pii(text)).otherwise(False), "_pii")
    inside = F.col("_may.direct") | F.col("_may.hidden") | F.col("_may_plain.plain")
    high = F.exists(injection.every_stage(text, "_plain"), lambda f: f["risk"] == "HIGH")
    injected = F.when(F.col("_may.sure") & ~body.rlike(ODD_LETTERS), True).when(inside & (F.length(body) > 0), high).otherwise(False)
    found = F.struct(injected.alias("injected"), F.when(F.col("_may.offensive"), injection.offensive(body)).otherwise(injection.inoffensive()).alias("offensive"))
    return _once(rows, found, "_found").withColumns({"_injected": F.col("_found.injected"), "_offensive": F.col("_found.offensive")}).drop("_plain", "_may", "_may_plain", "_found")


def scans_of(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``scan_texts`` of texts that many calls share, by ``keys``, without the texts."""
    return scan_texts(texts, text, mailed=True).select(*keys, "_mailed", "_pii", "_injected", "_offensive")


def decide(calls: DataFrame, threshold: str = "HIGH", stages: Sequence[str] = STAGES, taint: DataFrame | None = None, chains: DataFrame | None = None, anomaly: DataFrame | None = None, text: str = "args", anomaly_score: float = 0.7, scans: tuple[DataFrame, Sequence[str]] | None = None) -> DataFrame:
    """First stage that speaks decides: ``request_id, tool_name, role, action, risk, rule, stage``.

    ``taint`` (request_id), ``chains`` (request_id, chain_id) and ``anomaly``
    (request_id, score, reason) are tables of what other operators found; each
    is joined on the request once. ``scans``: the table of ``scans_of`` and its
    keys, for calls that carry keys of a shared text instead of ``text``. The
    rules then see ``args`` as they are, without that text.
    """
    tool, args = F.col("tool_name"), F.col("args")
    for name, found, columns in (("taint", taint, ["request_id"]), ("chain", chains, ["request_id", "chain_id"]), ("anomaly", anomaly, ["request_id", "score", "reason"])):
        if found is not None:
            one = found.select(*columns).groupBy("request_id").agg(F.lit(True).alias(f"_{name}"), *[F.max(c).alias(f"_{name}_{c}") for c in columns[1:]])
            calls = calls.join(one, "request_id", "left")
        else:
            extra = {"chain": {"_chain_chain_id": F.lit(None).cast("string")}, "anomaly": {"_anomaly_score": F.lit(None).cast("double"), "_anomaly_reason": F.lit(None).cast("string")}}.get(name, {})
            calls = calls.withColumns({f"_{name}": F.lit(False), **extra})
    if scans is None:
        calls = _once(calls, F.array_compact(F.array(*[r.evaluate(tool, args) for r in RULES])), "_said")
        calls = scan_texts(calls, text, "pii" in stages)
    else:
        calls = _ruled(calls, scans)
    hard = F.filter("_said", lambda o: o["action"] == "BLOCK")
    soft = F.filter("_said", lambda o: o["action"] != "BLOCK")
    level = risk_level(tool)
    dynamic = lambda action, risk, reason, rule: F.struct(F.lit(action).alias("action"), risk.alias("risk"), F.lit(reason).alias("reason"), F.lit(rule).alias("rule"))
    result = {
        "hard_rule": F.get(hard, 0),
        "injection": F.when(F.col("_injected"), outcome("BLOCK", "HIGH", "injected instructions", "prompt-injection")),
        "offensive": F.when(F.col("_offensive.detected"), outcome("BLOCK", "CRITICAL", F.col("_offensive.category"), "offensive-request")),
        "taint": F.when(F.col("_taint") & sensitive_sink(tool), outcome("REQUIRES_APPROVAL", "HIGH", "untrusted data in a sensitive sink", "taint-flow")),
        "chain": F.when(F.col("_chain"), F.struct(F.lit("REQUIRES_APPROVAL").alias("action"), F.lit("HIGH").alias("risk"), F.col("_chain_chain_id").alias("reason"), F.lit("attack-chain").alias("rule"))),
        "soft_rule": F.get(soft, 0),
        "pii": F.when(F.col("_pii") if "pii" in stages else F.lit(False), dynamic("REDACT", level, "personal data", "pii-redact")),
        "anomaly": F.when(F.col("_anomaly_score") >= anomaly_score, dynamic("REQUIRES_APPROVAL", level, "anomaly", "anomaly")),
        "rbac": F.when(~may_execute(F.col("role"), tool), dynamic("BLOCK", level, "role", "rbac")),
        "threshold": F.when(requires_approval(tool, threshold), dynamic("REQUIRES_APPROVAL", level, "risk threshold", "risk-threshold")),
    }
    named = [F.when(result[s].isNotNull(), F.struct(result[s].alias("o"), F.lit(s).alias("stage"))) for s in stages]
    last = F.struct(dynamic("ALLOW", level, "default", "default-allow").alias("o"), F.lit("default").alias("stage"))
    kept = calls.select("request_id", "tenant_id", "tool_name", "role", "ts", *[c for c in calls.columns if c.startswith("_") and c != "_name"])
    return _once(kept, F.coalesce(*named, last), "d").select("request_id", "tenant_id", "tool_name", "role", "ts", "d.o.action", "d.o.risk", "d.o.rule", "d.o.reason", "d.stage")


def _ruled(calls: DataFrame, scans: tuple[DataFrame, Sequence[str]]) -> DataFrame:
    """Calls with what is known of their texts and what the rules say (``_said``), which are asked once for each tool and arguments."""
    rules = [Rule(r.name, partial(_email, holds=F.col("_holds"))) if r.name == "external-email-pii" else r for r in RULES]
    kinds = calls.select("tool_name", "args").distinct().withColumn("_holds", F.explode(F.array(F.lit(True), F.lit(False))))
    said = _once(kinds, F.array_compact(F.array(*[r.evaluate(F.col("tool_name"), F.col("args")) for r in rules])), "_said")
    known = settled(said.select("_holds", "_said", F.col("tool_name").alias("_kind_tool"), F.col("args").alias("_kind_args")))
    rows = calls.join(scans[0], list(scans[1]), "left")
    same = F.col("tool_name").eqNullSafe(F.col("_kind_tool")) & F.col("args").eqNullSafe(F.col("_kind_args")) & (F.coalesce("_mailed", F.lit(False)) == F.col("_holds"))
    return rows.join(known, same, "left").drop("_kind_tool", "_kind_args", "_holds")


def decide_shared(calls: DataFrame, text: str = "args", carry: Sequence[str] = (), **options) -> DataFrame:
    """``decide`` for tables in which many calls share tool, role, arguments and text: each such kind of call is decided once.

    ``carry``: further columns of the calls. ``options`` as in ``decide``, but no tables by request. Kinds of calls are joined
    back by all their columns; they are a broadcast where they are few, and a table as large as the calls where none is shared.
    """
    shared = list(dict.fromkeys(("tool_name", "role", "args", text)))
    empty = {"request_id": F.monotonically_increasing_id().cast("string"), "tenant_id": F.lit(None).cast("string"), "ts": F.lit(None).cast("timestamp")}
    kinds = settled(calls.select(*shared).distinct().withColumns(empty))  # numbered once
    spread = kinds.repartition(max(kinds.rdd.getNumPartitions(), kinds.sparkSession.sparkContext.defaultParallelism))
    said = ("action", "risk", "rule", "reason", "stage")
    known = settled(decide(spread, text=text, **options).select("request_id", *said).join(kinds.select("request_id", *[F.col(c).alias(f"_kind_{c}") for c in shared]), "request_id").drop("request_id"))
    same = [F.col(c).eqNullSafe(F.col(f"_kind_{c}")) for c in shared]
    return calls.join(known, same, "left").select("request_id", "tenant_id", "tool_name", "role", "ts", *said, *carry)


def apply_advice(decisions: DataFrame, advice: DataFrame) -> DataFrame:
    """Advice by tool, or by tool and arguments where both sides have ``args_hash`` (``ledger.args_hash``).

    A risk of 0.85 that suggests a block blocks, of 0.6 turns ALLOW into an approval; never the other way.
    """
    key = ["tool_name", *(["args_hash"] if "args_hash" in advice.columns and "args_hash" in decisions.columns else [])]
    known = advice.groupBy(*key).agg(F.max_by(F.struct("risk", "suggests_block"), "risk").alias("_a"))
    rows = decisions.withColumnRenamed("risk", "_risk").join(known, key, "left").withColumnRenamed("_risk", "risk")
    base = F.col("action").isin("ALLOW", "REDACT")
    action = F.when(base & (F.col("_a.risk") >= 0.85) & F.col("_a.suggests_block"), "BLOCK").when((F.col("action") == "ALLOW") & (F.col("_a.risk") >= 0.6), "REQUIRES_APPROVAL").otherwise(F.col("action"))
    return rows.withColumn("advised_action", action).drop("_a")


# What each framework looks at; confidence = base + step per type, or the best finding's.
FRAMEWORKS = {
    "HIPAA": (("SSN", "MEDICAL_RECORD_NUMBER", "DATE_OF_BIRTH", "NHS", "IP_ADDRESS", "EMAIL", "PHONE"), 0.4, 0.15),
    "GDPR": (("EMAIL", "PHONE", "IP_ADDRESS", "IPV6", "PASSPORT", "IBAN", "BITCOIN_ADDR", "ETHEREUM_ADDR", "MAC_ADDR"), 0.5, 0.1),
    "CCPA": (("EMAIL", "PHONE", "IP_ADDRESS", "IPV6", "PASSPORT", "IBAN", "BITCOIN_ADDR", "ETHEREUM_ADDR", "MAC_ADDR"), 0.4, 0.1),
    "FERPA": (("STUDENT_RECORD", "DATE_OF_BIRTH", "SSN"), 0.4, 0.2),
    "DPDP": (("AADHAAR", "PAN", "PHONE", "EMAIL"), 0.5, 0.1),
}


SOX_TOOLS = "payment|payout|invoice|ledger|financial_(report|disclosure)|\\bgaap\\b"
EU_DOMAINS = ("eu", "uk", "de", "fr", "it", "es", "nl", "be", "se", "no", "fi", "dk", "pl", "cz", "at", "ie", "pt", "gr")
#: Where each framework speaks of what was found; short names of the published texts.
CITATIONS = {
    "PCI_DSS": "PCI DSS v4.0 Req 3", "HIPAA": "45 CFR 164.514(b)(2)", "GDPR": "GDPR Art. 4(1), 6, 32", "CCPA": "CCPA 1798.140(o)", "SOX": "SOX 404", "FERPA": "20 USC 1232g; 34 CFR 99", "DPDP": "DPDP Act 2023, 3, 8",
}
DISCLAIMER = "Triage signal from pattern matching, not a legal determination."


def regulatory_hints(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, framework, n_types, confidence`` from findings with ``type`` and ``confidence``; triage signals, no legal findings."""
    best = found.groupBy(*keys, "type").agg(F.max("confidence").alias("confidence"))
    frameworks = {**{n: v[0] for n, v in FRAMEWORKS.items()}, "PCI_DSS": ("CREDIT_CARD",)}
    tags = F.array_compact(F.array(*[F.when(F.col("type").isin(*types), n) for n, types in frameworks.items()]))
    per = best.select(*keys, "type", "confidence", F.explode(tags).alias("framework")).groupBy(*keys, "framework").agg(F.count("*").alias("n_types"), F.max("confidence").alias("_best"))
    score = F.coalesce(*[F.when(F.col("framework") == n, F.lit(base) + F.lit(step) * F.col("n_types")) for n, (_, base, step) in FRAMEWORKS.items()], F.col("_best"))
    return per.select(*keys, "framework", "n_types", F.least(F.lit(1.0), score).alias("confidence"))


def call_hints(calls: DataFrame, found: DataFrame) -> DataFrame:
    """``request_id, framework, n_types, confidence, citation, disclaimer`` of calls.

    By the personal data found in them (``found``: request_id, type,
    confidence), by tool names of financial actions (SOX), and by a mail
    address under a European domain where nothing else says GDPR.
    """
    by_type = regulatory_hints(found, ["request_id"])
    hint = lambda name, confidence: F.struct(F.lit(name).alias("framework"), F.lit(0).cast("long").alias("n_types"), F.lit(confidence).alias("confidence"))
    mail = F.lower("args").rlike(r"@[a-z0-9.-]+\.(?:" + "|".join(EU_DOMAINS) + r")(?:[^a-z]|$)")
    named = F.array_compact(F.array(F.when(F.lower("tool_name").rlike(SOX_TOOLS), hint("SOX", 0.55)), F.when(mail, hint("GDPR", 0.4))))
    by_call = calls.select("request_id", F.explode(named).alias("h")).select("request_id", "h.*")
    both = by_type.unionByName(by_call).groupBy("request_id", "framework").agg(F.max_by(F.struct("n_types", "confidence"), F.struct("n_types", "confidence")).alias("h"))
    return both.select("request_id", "framework", "h.*", lookup(F.col("framework"), CITATIONS).alias("citation"), F.lit(DISCLAIMER).alias("disclaimer"))


#: What to do instead, by rule; our own wording.
SAFE_ALTERNATIVES = {
    "dangerous-shell": "Run a narrower command inside the sandbox.", "dangerous-sql": "Add a WHERE clause and run the statement in a transaction.", "external-email-pii": "Remove personal data or send to a corporate address.",
    "production-deploy": "Deploy to staging and attach a change ticket.", "payment": "Prepare a draft payment for approval.", "social-publish": "Create a draft.", "filesystem-sandbox": "Use a path inside the sandbox.",
    "browser-scrape": "Fetch from an allowed host over https.", "prompt-injection": "Send the text without quoted instructions.", "offensive-request": "Ask for an audit or hardening, with authorisation.",
    "taint-flow": "Summarise the untrusted content before it is sent on.", "attack-chain": "Do not pass on the output of the call before; ask again after a review.",
}


def safe_alternative(decisions: DataFrame, advice: DataFrame | None = None) -> DataFrame:
    """Adds ``safe_alternative``: the rule's, else the rewrite advised for the tool (``advice``: tool_name, safe_rewrite)."""
    own = lookup(F.col("rule"), SAFE_ALTERNATIVES)
    if advice is None:
        return decisions.withColumn("safe_alternative", own)
    rewrites = advice.groupBy("tool_name").agg(F.min("safe_rewrite").alias("_rewrite"))
    return decisions.join(rewrites, "tool_name", "left").withColumn("safe_alternative", F.coalesce(own, "_rewrite")).drop("_rewrite")


# Rules whose blocks are final, whatever their risk.
NEVER_OVERRIDABLE = (
    "dangerous-shell-fork-bomb", "dangerous-shell-disk-wipe", "dangerous-shell-recursive-root-delete", "dangerous-sql-drop-without-where", "dangerous-sql-truncate",
    "dangerous-sql-grant-superuser", "payment-no-idempotency", "production-deploy-no-ticket", "capability-token-replay", "capability-token-tampered",
)
#: The worst that can happen if the block was right, by rule or by its first two words; our own wording.
WORST_CASES = {
    "dangerous-shell": "Files outside the sandbox may be changed or lost.", "dangerous-sql": "More rows than meant may be changed or shown.", "external-email-pii": "Personal data may reach an outsider.",
    "social-publish": "The post may be seen by everyone.", "browser-scrape": "The page may be hostile.", "filesystem-sandbox": "A path outside the sandbox may be written.", "production-deploy": "Live traffic may be affected.",
}
WORST_CASE = "The call may have side effects that were not meant."


def override_offers(blocks: DataFrame) -> DataFrame:
    """Offers for blocks that a person may override: ``request_id, rule, worst_case, scrutiny_calls, ttl_seconds``.

    None for final rules, CRITICAL risks and sessions under scrutiny (column
    ``under_scrutiny``, if there is one). HIGH risks get 10 calls of scrutiny
    and 60 seconds, others 5 and 45.
    """
    free = ~F.coalesce("under_scrutiny", F.lit(False)) if "under_scrutiny" in blocks.columns else F.lit(True)
    rule = F.coalesce("rule", F.lit("unknown-rule"))
    rows = blocks.where((F.col("action") == "BLOCK") & ~rule.isin(*NEVER_OVERRIDABLE) & (F.col("risk") != "CRITICAL") & free)
    high = F.col("risk") == "HIGH"
    worst = F.coalesce(lookup(rule, WORST_CASES), lookup(F.substring_index(rule, "-", 2), WORST_CASES), F.lit(WORST_CASE))
    return rows.select("request_id", rule.alias("rule"), worst.alias("worst_case"), F.when(high, 10).otherwise(5).alias("scrutiny_calls"), F.when(high, 60).otherwise(45).alias("ttl_seconds"))


def validate_overrides(requests: DataFrame, blocks: DataFrame, offers: DataFrame, least_reason: int = 8) -> DataFrame:
    """``override_id, request_id, refused``: the first reason against a request to override a block, null if it is accepted.

    ``requests``: override_id, request_id, human_reason. ``blocks``: request_id,
    action, risk, rule and ``valid_key``, null where the signature fails.
    """
    known = blocks.select("request_id", "action", "risk", "rule", "valid_key").join(offers.select("request_id", F.lit(True).alias("offered")), "request_id", "left")
    rows = requests.join(known, "request_id", "left")
    refused = (
        F.when(F.coalesce(F.length(F.trim("human_reason")), F.lit(0)) < least_reason, "MISSING_FIELDS").when(~F.coalesce(F.col("action") == "BLOCK", F.lit(False)), "NOT_A_BLOCK")
        .when(F.col("valid_key").isNull(), "INVALID_SIGNATURE").when(F.col("offered").isNull(), "NO_OFFER").when(F.col("rule").isin(*NEVER_OVERRIDABLE) | (F.col("risk") == "CRITICAL"), "NOT_OVERRIDABLE")
    )
    return rows.select("override_id", "request_id", refused.alias("refused"))
