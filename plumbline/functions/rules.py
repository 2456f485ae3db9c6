"""Policy rules: the gold answer of a state as one column expression per rule.

Limits, bands and categories are fixed values of the published policies.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import _c


def _map(key, values: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), _c(key))


def deploy_gate(tests, scan, approvals, freeze, hotfix) -> Column:
    need = F.when(_c(hotfix), 1).otherwise(2)
    return (_c(tests) == "passed") & _c(scan).isin("clean", "low") & (_c(approvals) >= need) & (~_c(freeze) | _c(hotfix))


def invoice_match(difference_pct, received, ordered, vendor_matches) -> Column:
    return (F.abs(_c(difference_pct)) <= 2) & (_c(received) == _c(ordered)) & _c(vendor_matches)


# Minutes to a first response per priority.
SLA_MINUTES = {"P1": 15, "P2": 60, "P3": 240, "P4": 1440}


def sla_breach(priority, waited, paused, limits: dict | None = None) -> Column:
    return (_c(waited) - _c(paused)) > _map(priority, limits or SLA_MINUTES)


def same_incident(service_a, service_b, signature_a, signature_b, minutes_between, window: int = 15) -> Column:
    return (_c(service_a) == _c(service_b)) & (_c(signature_a) == _c(signature_b)) & (_c(minutes_between) <= window)


def agent_escalates(asked_human, confidence, attempts, sentiment) -> Column:
    return _c(asked_human) | (_c(confidence) < 0.5) | (_c(attempts) >= 3) | (_c(sentiment) == "angry")


def goal_done(steps_done, steps_needed, any_failed) -> Column:
    return (_c(steps_done) == _c(steps_needed)) & ~_c(any_failed)


def goal_done_from_history(history, steps_needed) -> Column:
    """history: array of structs with an `error` field, null for a step that worked."""
    h = _c(history)
    return (F.size(h) == _c(steps_needed)) & ~F.exists(h, lambda s: s["error"].isNotNull())


def invalid_field(email, age, country, start) -> Column:
    """Which field of a payload is invalid: email, age 1 to 120, two capital letters, a date as YYYY-MM-DD."""
    years = _c(age).try_cast("int")
    bad_age = _c(age).isNull() | ~_c(age).rlike(r"^-?\d+$") | ~years.between(1, 120)
    bad_date = ~_c(start).rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_date(_c(start), "yyyy-MM-dd").isNull()
    return (F.when(~_c(email).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email").when(F.coalesce(bad_age, F.lit(True)), "age")
            .when(~_c(country).rlike(r"^[A-Z]{2}$"), "country_code").when(F.coalesce(bad_date, F.lit(True)), "start_date").otherwise("none"))


def pull_request_risk(lines, tests_added, sensitive, migration) -> Column:
    many, big = _c(lines) > 400, _c(lines) > 50
    return (F.when(_c(sensitive) & (_c(migration) | many), 3).when((_c(sensitive) & ~_c(tests_added)) | many | _c(migration), 2)
            .when(big | ~_c(tests_added), 1).otherwise(0))


def kyc_passes(age, document, sanctions, address) -> Column:
    return (_c(age) >= 18) & _c(document) & ~_c(sanctions) & _c(address)


def churn_risk(drop_pct, tickets, days_left) -> Column:
    return (F.when((_c(drop_pct) > 40) & (_c(days_left) <= 30), 3).when((_c(drop_pct) > 40) | ((_c(tickets) > 6) & (_c(days_left) <= 90)), 2)
            .when((_c(drop_pct) > 10) | (_c(tickets) > 3), 1).otherwise(0))


def needs_speaker_notes(audience, has_chart, numbers) -> Column:
    return (_c(has_chart) & _c(audience).isin("board", "executives")) | (_c(numbers) > 6)


# The tracking text of each exception class.
SHIPMENT_TEXTS = {"Delivery attempted: address not found": "address_issue", "Held by customs: documentation required": "customs_hold",
                  "Package damaged in transit; claim opened": "damaged", "No scan for 10 days; trace initiated": "lost",
                  "Delayed: severe weather at hub": "weather_delay", "Out for delivery": "on_track"}


def shipment_exception(events, classes: dict | None = None) -> Column:
    """Class of the latest entry of an array of status texts."""
    return _map(F.try_element_at(_c(events), F.lit(-1)), classes or SHIPMENT_TEXTS)


def tool_result_kind(status) -> Column:
    s = _c(status)
    return (F.when(s == 429, "rate_limited").when(s == 401, "auth_error").when(s == 404, "not_found").when(s == 400, "invalid_arguments")
            .when(s.isNull(), "timeout").when(s == 200, "success"))


def api_retry(status, method, has_key, attempts, max_attempts) -> Column:
    safe = _c(method).isin("GET", "PUT", "DELETE") | ((_c(method) == "POST") & _c(has_key))
    return _c(status).isin(429, 500, 502, 503, 504) & safe & (_c(attempts) < _c(max_attempts))


def refund_eligible(days_since, window, category, final_sale, returned_before, excluded=("gift_card", "perishable")) -> Column:
    return (_c(days_since) <= _c(window)) & ~_c(category).isin(list(excluded)) & ~_c(final_sale) & ~_c(returned_before)


def incident_severity(error_rate, affected, customer_facing, data_loss) -> Column:
    e, a, c = _c(error_rate), _c(affected), _c(customer_facing)
    return F.when(_c(data_loss) | (c & ((e >= 30) | (a >= 5000))), 3).when(c & ((e >= 5) | (a >= 50)), 2).when((e >= 1) | (a > 0), 1).otherwise(0)


# Approvals and hours per sensitivity.
APPROVALS = {"public": 0, "internal": 1, "confidential": 1, "restricted": 2}
MAX_HOURS = {"public": 720, "internal": 720, "confidential": 24, "restricted": 8}


def access_allowed(sensitivity, approvals, hours, mfa) -> Column:
    return (_c(approvals) >= _map(sensitivity, APPROVALS)) & (_c(hours) <= _map(sensitivity, MAX_HOURS)) & (_c(mfa) | _c(sensitivity).isin("public", "internal"))


def ticket_route(topic, tier) -> Column:
    return (F.when(_c(topic) == "security", "security").when(_c(tier) == "enterprise", "account_team").when((_c(topic) == "how_to") & (_c(tier) == "free"), "self_serve")
            .when(_c(topic) == "billing", "billing").when(_c(topic).isin("bug", "how_to"), "support_engineering"))


# How much a changed setting weakens security (2), capacity or behaviour (1) or neither (0).
CONFIG_WEIGHT = {"log_level": 0, "feature_flags.new_search": 1, "replicas": 1, "db.max_connections": 1, "tls.min_version": 2, "auth.session_ttl_hours": 2, "cors.allowed_origins": 2}


def config_risk(environment, keys) -> Column:
    worst = F.array_max(F.transform(_c(keys), lambda k: _map(k, CONFIG_WEIGHT)))
    prod = _c(environment) == "prod"
    return F.when(worst == 2, F.when(prod, 3).otherwise(2)).when(worst == 1, F.when(prod, 1).otherwise(0)).otherwise(0)


def repeats_a_call(calls, times: int = 3) -> Column:
    """Whether an array of calls holds the same call `times` times in a row."""
    c = _c(calls)
    starts = F.sequence(F.lit(0), F.greatest(F.size(c) - times, F.lit(0)))
    run = F.exists(starts, lambda i: F.forall(F.sequence(F.lit(1), F.lit(times - 1)), lambda j: F.get(c, i) == F.get(c, i + j)))
    return (F.size(c) >= times) & run


# Line patterns of the log problems.
LOG_PATTERNS = {"disk_full": "no space left on device", "oom": "(?i)out of memory|OutOfMemoryError", "auth_failure": "authentication failed|401 Unauthorized",
                "network": "connection refused|upstream connect error"}


def log_anomaly(lines, patterns: dict | None = None) -> Column:
    out = None
    for name, pattern in (patterns or LOG_PATTERNS).items():
        cond = F.exists(_c(lines), lambda x: x.rlike(pattern))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("none")


# Failure cause per step of a run.
CI_CAUSES = {"pytest": "test_failure", "build": "build_error", "setup": "infra_timeout", "lint": "lint", "install": "dependency_resolution"}


def ci_failure_cause(steps) -> Column:
    """steps: array of structs (name, status) in order."""
    failed = F.get(F.filter(_c(steps), lambda s: s["status"] == "failure"), F.lit(0))["name"]
    return _map(failed, CI_CAUSES)


def words_in(bullets) -> Column:
    return F.aggregate(_c(bullets), F.lit(0), lambda a, b: a + F.size(F.filter(F.split(b, r"(?U)\s+"), lambda w: w != "")))


def slide_density(words) -> Column:
    w = _c(words)
    return F.when(w <= 30, 0).when(w <= 60, 1).when(w <= 100, 2).otherwise(3)


def split_slide(n_bullets, words) -> Column:
    return (_c(n_bullets) > 6) | (_c(words) > 90)


def needs_image(purpose, has_image) -> Column:
    return _c(purpose).isin("product_showcase", "team_intro", "office_location") & ~_c(has_image)


def slide_layout(data_series, comparison, image, bullets) -> Column:
    return (F.when(_c(data_series).isNotNull(), "chart").when(_c(comparison).isNotNull(), "two_column").when(_c(image).isNotNull(), "image_with_caption")
            .when(F.size(_c(bullets)) > 0, "title_bullets").otherwise("title_only"))
