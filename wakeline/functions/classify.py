"""Rule chains: file kind, technical role, tiers, errors, deadlines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths

#: Role rules on the lower-cased path, in order; None for rules on the kind.
ROLE_RULES = (
    ("styling", "stylesheet graph role", "strong", None, ("style",)),
    ("configuration", "tooling/configuration path convention", "strong", r"(?:config|\.env|scripts/)", ("tooling",)),
    ("testing", "test path convention", "strong", r"(?:^|/)(?:test|tests|__tests__|spec)(?:/|\.|$)", ()),
    ("ui_primitive", "UI primitive path convention", "strong", r"(?:components/ui|/ui/|design-system|primitives)", ()),
    ("analytics", "dedicated analytics path convention", "strong", r"(?:analytics|telemetry|tracking|segment|posthog|mixpanel)", ()),
    ("infrastructure", "infrastructure path convention", "strong", r"(?:^|/)(?:db|database|cache|queue|transport|adapter|storage|cloudinary|provider|infra)(?:/|$)", ()),
    ("presentation", "component graph role", "strong", None, ("component",)),
    ("utility", "utility path convention", "heuristic", r"(?:utils?|helpers?|format|constants?)", ()),
    ("application", "application code without a stronger technical role", "heuristic", None, ("module", "shared_module", "page", "api_route", "layout", "loading", "error_boundary", "metadata")),
)
UNKNOWN_ROLE = ("unknown", "no deterministic technical-role rule", "unknown")
TIERS = ("primary", "secondary", "technical_only", "evidence_only")
TECHNICAL_ROLES = ("analytics", "infrastructure", "styling", "configuration", "testing", "ui_primitive")
#: Attempts, backoff, lease and deadlines in seconds, and what counts as transient.
MAX_ATTEMPTS, FIRST_BACKOFF, LATER_BACKOFF, LEASE = 3, 30, 120, 600
DEADLINES = {"installation.sync": 480, "branch.reconcile": 480, "branch.push": 300, "pull_request.analyze": 300}
OTHER_DEADLINE = 30
NETWORK_CODES = ("ECONNRESET", "ECONNREFUSED", "ETIMEDOUT", "ENOTFOUND", "EAI_AGAIN")
TRANSIENT = "(?i)network|connection|socket|database.*(unavailable|timeout)|timeout"


def file_kind(path: Column, exports_component: Column) -> Column:
    """struct(kind, reason) of a source file before entrypoints are laid over."""
    rule = lambda kind, reason: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    jsx = path.rlike(paths.JSX)
    return (
        F.when(path.rlike(paths.STYLE), rule("style", "stylesheet extension convention"))
        .when(paths.is_tooling(path), rule("tooling", "repository tooling/configuration convention"))
        .when(jsx & path.rlike("(^|/)(components|ui)/"), rule("component", "component directory convention"))
        .when(jsx & exports_component, rule("component", "JSX module exports a component candidate"))
        .otherwise(rule("module", "generic JavaScript/TypeScript module"))
    )


def technical_role(path: Column, kind: Column) -> Column:
    """struct(role, reason, strength)."""
    lower = F.lower(path)
    struct = lambda role, reason, strength: F.struct(F.lit(role).alias("role"), F.lit(reason).alias("reason"), F.lit(strength).alias("strength"))
    out = None
    for role, reason, strength, pattern, kinds in ROLE_RULES:
        test = lower.rlike(pattern) if pattern else F.lit(False)
        test = test | kind.isin(*kinds) if kinds else test
        out = (F if out is None else out).when(test, struct(role, reason, strength))
    return out.otherwise(struct(*UNKNOWN_ROLE))


def tier(role: Column, direct: Column) -> Column:
    """F8."""
    return (
        F.when(direct | (role == "application"), "primary")
        .when(role.isin("presentation", "utility"), "secondary")
        .when(role.isin(*TECHNICAL_ROLES), "technical_only")
        .otherwise("evidence_only")
    )


def tier_rank(value: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), value).cast("int") - 1


def impact_level(entrypoints: Column, route_changed: Column) -> Column:
    """two affected entrypoints are high, a changed route is medium, anything else low."""
    return F.when(entrypoints >= 2, "high").when(route_changed, "medium").otherwise("low")


def policy_reason(tier_: Column, role: Column, seed: Column, entrypoint: Column, length: Column) -> Column:
    """why an entrypoint has its tier."""
    said = lambda text, *columns: F.format_string(text, *columns)
    # The sentences are part of the result.
    return (
        F.when((tier_ == "primary") & (length == 1), said("Primary because `%s` is changed directly.", entrypoint))
        .when(tier_ == "primary", said("Primary because changed %s code `%s` reaches `%s` through a resolved import path.", role, seed, entrypoint))
        .when(tier_ == "secondary", said("Secondary because changed %s code `%s` reaches `%s` indirectly.", role, seed, entrypoint))
        .when(tier_ == "technical_only", said("Technical-only because changed `%s` is classified as %s; its reachability to `%s` is retained as evidence.", seed, role, entrypoint))
        .otherwise(said("Evidence-only because changed `%s` has no reliable technical-role classification.", seed))
    )


def error_kind(typed: Column, status: Column, code: Column, message: Column) -> Column:
    """Timeout, cancelled, transient or permanent; the first rule that holds."""
    return (
        F.when(typed == "timeout", "timeout")
        .when(typed == "cancelled", "cancelled")
        .when((status == 429) | (status >= 500), "transient")
        .when(code.isin(*NETWORK_CODES), "transient")
        .when(message.rlike(TRANSIENT), "transient")
        .otherwise("permanent")
    )


def backoff_seconds(attempt: Column) -> Column:
    """X24."""
    return F.when(attempt <= 1, FIRST_BACKOFF).otherwise(LATER_BACKOFF)


def deadline_seconds(job_type: Column) -> Column:
    """X26."""
    out = F
    for name, seconds in DEADLINES.items():
        out = out.when(job_type == name, seconds)
    return out.otherwise(OTHER_DEADLINE)


def guidance_failure(output_kind: Column, status: Column, message: Column, missing: str = r"key is not configured") -> Column:
    """The category of a failed guidance call; typed output errors first. ``missing``: how a missing credential is told."""
    lower = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(output_kind.isin("empty_output", "malformed_json", "schema_validation", "evidence_validation"), output_kind)
        .when(lower.rlike(missing), "configuration")
        .when(status.isin(401, 403) | lower.rlike("api[ _-]?key|authentication|unauthorized|forbidden"), "authentication")
        .when((status == 429) | lower.rlike("rate limit"), "rate_limited")
        .when((status >= 500) | lower.rlike("network|connection|timeout|unavailable"), "provider_unavailable")
        .when(status == 400, "provider_request_rejected")
        .when(status == 404, "model_unavailable")
        .otherwise("unknown")
    )


def safe_token(value: Column) -> Column:
    """A short plain token, else null."""
    return F.when(value.rlike("(?i)^[a-z0-9_.-]{1,100}$"), value)


def safe_diagnostic(status: Column, message: Column) -> Column:
    """A request or schema diagnostic that names no secret, else null."""
    text = F.trim(F.regexp_replace(message, r"\s+", " "))
    told = r"(?i)(?:schema|json|structured|response[_ -]?format|model|parameter|unsupported|invalid request|invalid value)"
    secret = r"(?i)(?:api[ _-]?key|authorization|bearer|secret|password|\bsk-[a-z0-9_-]+)"
    return F.when(status.isin(400, 404, 422) & (text != "") & (F.length(text) <= 400) & ~text.rlike(secret) & text.rlike(told), text)
