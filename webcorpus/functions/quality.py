"""Page and response labels (FLT3-6, CLS1-3, AGG6).

All predicates are native ``contains`` / ``rlike`` chains on a lower-cased column, so
they stay inside whole-stage code generation. The block predicate matches articles
*about* captchas too; it is a label, never a delete.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------
BLOCK_PHRASES = ("unusual traffic", "captcha", "sorry/index", "detected unusual traffic",
                 "automated requests", "please verify", "access denied", "bot detected")
RESULTS_BLOCK_PHRASES = ("unusual traffic", "captcha", "sorry/index", "ipv4.google.com/sorry",
                         "detected unusual traffic", "automated requests")
MIN_PAGE_CHARS = 100
HTTP_ACCEPT_MIN_CHARS = 500
RENDERED_ACCEPT_MIN_CHARS = 1000
# Challenge classes in the order they are tried; first match wins.
CHALLENGE_PATTERNS = (
    ("recaptcha_v2", (r"g-recaptcha", r"grecaptcha", r"recaptcha/api2", r"data-sitekey=\"([^\"]+)\"")),
    ("recaptcha_v3", (r"recaptcha/api\.js\?render=", r"grecaptcha\.execute", r"recaptcha-v3")),
    ("hcaptcha", (r"h-captcha", r"hcaptcha\.com", r"data-hcaptcha-sitekey")),
    ("cloudflare", (r"cf-browser-verification", r"cloudflare", r"cf-turnstile",
                    r"challenges\.cloudflare\.com", r"just a moment", r"checking your browser",
                    r"ray id")),
    ("funcaptcha", (r"funcaptcha", r"arkoselabs")),
    ("image_captcha", (r"captcha\.(jpg|png|gif|jpeg)", r"captchaimage", r"captcha-image")),
)
# Error taxonomy rules, tried in this order on the lower-cased message.
ERROR_RULES = (
    ("captcha_detected", ("captcha", "verify", "robot"),
     "Captcha detected - search engine requires verification"),
    ("blocked", ("block", "denied", "forbidden", "403"),
     "Request blocked by search engine anti-bot protection"),
    ("rate_limited", ("rate", "limit", "429", "too many"),
     "Rate limited - too many requests, please wait"),
    ("timeout", ("timeout", "timed out"),
     "Request timed out - search engine took too long to respond"),
    ("selector_mismatch", ("selector", "parse", "extract"),
     "Selector mismatch - search engine layout may have changed"),
    ("engine_unavailable", ("unavailable", "failed"), None),  # keeps the original message
)
NO_RESULTS = ("no_results",
              "No results found - search may have returned empty or selectors may be outdated")
UNKNOWN = ("unknown_error", "Unknown error occurred")
DEFAULT_ENGINE_TIMEOUT = 30.0
# ---------------------------------------------------------------------------------


def _any_contains(low: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def is_blocked_page(html: Column) -> Column:
    """FLT3: null or shorter than 100 characters, or any block phrase."""
    return F.coalesce(html.isNull() | (F.length(html) < MIN_PAGE_CHARS)
                      | _any_contains(F.lower(html), BLOCK_PHRASES), F.lit(True))


def is_blocked_results_page(html: Column) -> Column:
    """FLT4: any results-page block phrase."""
    return F.coalesce(_any_contains(F.lower(html), RESULTS_BLOCK_PHRASES), F.lit(False))


def challenge_type(html: Column) -> Column:
    """FLT6: first challenge class whose pattern matches the lower-cased page."""
    low = F.lower(html)
    out = None
    for name, pats in CHALLENGE_PATTERNS:
        cond = F.lit(False)
        for p in pats:
            cond = cond | low.rlike(p)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def challenge_pattern(html: Column) -> Column:
    """FLT6: the pattern that matched first (null when none)."""
    low = F.lower(html)
    out = None
    for _, pats in CHALLENGE_PATTERNS:
        for p in pats:
            cond = low.rlike(p)
            out = F.when(cond, F.lit(p)) if out is None else out.when(cond, F.lit(p))
    return out


def capture_accepted(status_code: Column, html: Column, rendered: Column | bool = False) -> Column:
    """FLT5: plain fetch needs status 200 and more than 500 characters; a rendered
    capture needs more than 1000 characters. A blocked page is never accepted."""
    n = F.coalesce(F.length(html), F.lit(0))
    rendered = F.lit(rendered) if isinstance(rendered, bool) else rendered
    ok = F.when(rendered, n > RENDERED_ACCEPT_MIN_CHARS).otherwise((status_code == 200) & (n > HTTP_ACCEPT_MIN_CHARS))
    return ok & ~is_blocked_page(html)


def error_type(error: Column, n_results: Column) -> Column:
    """CLS1: ordered substring rules on the message, else no_results when there are
    no results, else unknown_error. Misfires are kept (e.g. 'strategies' contains
    'rate')."""
    low = F.lower(error)
    out = None
    for name, words, _ in ERROR_RULES:
        cond = F.coalesce(_any_contains(low, words), F.lit(False))
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.when(F.coalesce(n_results, F.lit(0)) == 0, F.lit(NO_RESULTS[0])).otherwise(F.lit(UNKNOWN[0]))


def error_message(error: Column, n_results: Column) -> Column:
    """CLS1 descriptive message for ``error_type``."""
    low = F.lower(error)
    out = None
    for _, words, msg in ERROR_RULES:
        cond = F.coalesce(_any_contains(low, words), F.lit(False))
        val = error if msg is None else F.lit(msg)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return (out.when(F.coalesce(n_results, F.lit(0)) == 0, F.lit(NO_RESULTS[1]))
            .otherwise(F.coalesce(error, F.lit(UNKNOWN[1]))))


def normalize_response(df, success="success", n_results="n_results", error="error"):
    """CLS2: success only with results and the flag; error fields only on failure."""
    ok = F.coalesce(F.col(success), F.lit(False)) & (F.coalesce(F.col(n_results), F.lit(0)) > 0)
    return (df.withColumn("_ok", ok)
            .withColumn("error_type", F.when(~F.col("_ok"), error_type(F.col(error), F.col(n_results))))
            .withColumn("error_message", F.when(~F.col("_ok"), error_message(F.col(error), F.col(n_results))))
            .withColumn(success, F.col("_ok")).drop("_ok"))


def apply_timeout(df, timeout: float = DEFAULT_ENGINE_TIMEOUT):
    """CLS3: an attempt slower than the per-engine timeout becomes a failure with no
    results and the message ``Engine timed out after {timeout}s``."""
    late = F.col("response_time") > timeout
    return (df.withColumn("success", F.when(late, F.lit(False)).otherwise(F.col("success")))
            .withColumn("n_results", F.when(late, F.lit(0)).otherwise(F.col("n_results")))
            .withColumn("error", F.when(late, F.lit(f"Engine timed out after {timeout}s")).otherwise(F.col("error"))))


def quality_score(successes: Column, failures: Column, response_time: Column) -> Column:
    """AGG6: 0.7 x success rate + 0.3 x speed; 0.5 without history; speed is
    max(0, 1 - rt/10), or 0.5 when no response time is known."""
    total = successes + failures
    speed = F.when(F.coalesce(response_time, F.lit(0.0)) > 0,
                   F.greatest(F.lit(0.0), 1 - response_time / 10)).otherwise(F.lit(0.5))
    return F.when(total == 0, F.lit(0.5)).otherwise(successes / total * 0.7 + speed * 0.3)
