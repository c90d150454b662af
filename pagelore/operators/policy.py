"""Signals in page blocks that call for care: challenges, sign-in flows, writes, and hosts outside an allow list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.functions import text as T

# --- fixed values: phrases, matched as whole words ----------------------------------------------------------------
BOT = ["captcha", "recaptcha", "hcaptcha", "verify you are human", "verify you're human", "human verification", "are you human", "security challenge", "robot check", "checking your browser", "cloudflare", "cf-challenge", "press and hold", "unusual traffic"]
MFA = ["two-factor", "2fa", "mfa", "verification code", "security code", "one-time password", "one time password", "otp", "authenticator", "passkey", "verify it's you", "verify it is you", "approve sign in", "approve login"]
AUTH_LINK = ["forgot password", "continue with google", "continue with apple", "continue with microsoft", "continue with github", "continue with password", "use your password", "sign in", "log in", "passkey"]
AUTH = ["sign in", "sign-in", "log in", "login", "username", "password", "email address", "verification code", "security code", "one-time password", "one time password", "otp", "authenticator", "passkey", "continue with password", "use your password", "enter password"]
WRITE = ["checkout", "buy now", "purchase", "place order", "confirm purchase", "confirm payment", "pay now", "submit payment", "authorize payment", "transfer", "send money", "withdraw", "delete account", "remove workspace", "remove repository", "permanently delete", "confirm delete", "book now", "submit application"]
INTERACTIVE = ["form", "button", "input", "link"]
SPOKEN = ["form", "input", "button", "heading", "metadata", "text"]
# --- end of fixed values ------------------------------------------------------------------------------------------


def signal_text() -> Column:
    """Text, name, input type, target, tag and zone of a block."""
    return F.concat_ws(" ", "text", *[F.get_json_object("attributes", f"$.{k}") for k in ("name", "inputType", "href", "tagName", "zone")])


def normalize_allowlist(domains: Column) -> Column:
    clean = F.transform(domains, lambda d: F.lower(F.regexp_replace(F.trim(d), "^\\.+", "")))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda d: d != "")))


def host(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit("")))


def allowed(h: Column, allowlist: list[str]) -> Column:
    out = F.lit(False)
    for d in allowlist:
        out = out | (h == d) | h.endswith("." + d)
    return out


def signals(blocks: DataFrame, allowlist: list[str]) -> DataFrame:
    """page, ref and kind of every signal of the blocks (page, kind, role, ref, text, attributes, url); page signals have a null
    ref. Challenges and sign-in flows count only on pages with something to act on."""
    t = signal_text()
    k = F.col("kind")
    surface = blocks.groupBy("page").agg(F.max(k.isin(INTERACTIVE)).alias("surface"))
    b = blocks.join(surface, "page")
    target = F.get_json_object("attributes", "$.href")
    target_host = F.when(target.rlike("^(?:mailto:|tel:|#)"), F.lit(None)).when(target.startswith("/"), host(F.col("url"))).otherwise(host(target))
    found = F.array(
        F.when(F.col("surface") & T.any_phrase(t, BOT), "bot-challenge"),
        F.when(F.col("surface") & k.isin(SPOKEN) & T.any_phrase(t, MFA), "mfa-challenge"),
        F.when(F.col("surface") & ((F.lower(F.get_json_object("attributes", "$.inputType")) == "password") | ((k == "link") & T.any_phrase(t, AUTH_LINK)) | (k.isin(SPOKEN) & T.any_phrase(t, AUTH))), "sensitive-auth-flow"),
        F.when(k.isin(INTERACTIVE) & T.any_phrase(t, WRITE), "high-risk-write"),
        F.when(target_host.isNotNull() & ~allowed(target_host, allowlist), "domain-not-allowlisted"),
    )
    of_blocks = b.select("page", "ref", F.explode(F.array_compact(found)).alias("signal"))
    source = blocks.select("page", host(F.col("url")).alias("h")).distinct().where(F.col("h").isNotNull() & ~allowed(F.col("h"), allowlist))
    return of_blocks.union(source.select("page", F.lit(None).cast("string"), F.lit("domain-not-allowlisted")))
