"""Scalar functions and predicates over text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Addresses of cloud instance metadata.
METADATA_HOSTS = ("169.254.169.254", "metadata.google.internal", "metadata", "fd00:ec2::254", "169.254.170.2", "100.100.100.200", "169.254.169.253", "2852039166", "0xa9fea9fe", "0xa9.0xfe.0xa9.0xfe", "0251.0376.0251.0376", "::ffff:a9fe:a9fe", "::ffff:169.254.169.254")
#: Severities and evidence states, worst or strongest first.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
EVIDENCE_STATES = ("CONTRADICTED", "CORROBORATED", "PARTIALLY_CORROBORATED", "OBSERVED", "REPORTED", "REQUESTED", "UNKNOWN")


def rank(value: Column, order: tuple[str, ...]) -> Column:
    """Place of value in order, or its length where it is none of them."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), value), F.lit(0)) - 1, F.lit(len(order))).cast("int")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def words(text: Column) -> Column:
    """The distinct lower-cased words of ASCII letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 where both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / n)


def token_overlap(a: Column, b: Column) -> Column:
    """Share of the first list's items that the second has."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.filter(a, lambda t: F.array_contains(b, t))) / F.size(a))


def url_host(url: Column) -> Column:
    """Lower-cased host without user, port or brackets; null for what is no address or holds an escape in its host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:]*)", 1))
    return F.when((host == "") | host.contains("%"), None).otherwise(F.regexp_replace(host, r"[\[\]]", ""))


def destinations(command: Column) -> Column:
    """Hosts of the addresses in a command, in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(command, F.lit(r"([A-Za-z][A-Za-z0-9+.-]*://[^\s\"'<>]+)"), 1), url_host), lambda h: h.isNotNull()))


def is_allowed(host: Column, allowed: tuple[str, ...]) -> Column:
    """The host itself or a parent of it is allowed."""
    found = F.lit(False)
    for a in allowed:
        found = found | (host == a) | host.endswith("." + a)
    return found


def is_metadata(host: Column) -> Column:
    """Whether a host, in any case and with or without brackets, serves a cloud machine's own credentials; null for null."""
    return F.regexp_replace(F.lower(host), r"^\[|\]\z", "").isin(*METADATA_HOSTS)


def host_key(host: Column) -> Column:
    """Lower case; the first label unless it is a number address."""
    low = F.lower(F.trim(host))
    return F.when(low.rlike(r"^[0-9.]+\z|:"), low).otherwise(F.substring_index(low, ".", 1))


def executable(path: Column) -> Column:
    """Lower-cased last part of a path, without .exe."""
    return F.regexp_replace(F.lower(F.regexp_extract(path, r"([^/\\]*)\z", 1)), r"\.exe\z", "")


def refang(text: Column) -> Column:
    """Defanged addresses as they were: hxxp, [.], (.), [:] and [at]."""
    out = F.regexp_replace(text, r"(?i)\bhxxp", "http")
    for a, b in ((r"\[\.\]|\(\.\)|\[dot\]", "."), (r"\[:\]", ":"), (r"\[at\]|\[@\]", "@")):
        out = F.regexp_replace(out, "(?i)" + a, b)
    return out


def confusables(name: Column) -> Column:
    """Names that look alike folded to one: lower case, without - _ and ., 0 as o, 1 as l, rn as m, vv as w."""
    return F.replace(F.replace(F.translate(F.lower(name), "01-_.", "ol"), F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))


def version(text: Column) -> Column:
    """Numbers of a version, padded to four; what follows - or + is dropped."""
    parts = F.transform(F.split(F.regexp_extract(text, r"^v?([0-9.]*)", 1), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))
    return F.slice(F.concat(parts, F.array_repeat(F.lit(0), 4)), 1, 4)


def epoch_time(n: Column) -> Column:
    """A count of seconds, milli-, micro- or nanoseconds since 1970, told apart by magnitude."""
    micros = F.when(n < 100_000_000_000, n * 1_000_000).when(n < 100_000_000_000_000, n * 1000).when(n < 100_000_000_000_000_000, n).otherwise((n / 1000).cast("long"))
    return F.timestamp_micros(micros)


def phrase(text: Column, phrases: tuple[str, ...]) -> Column:
    """The first of the phrases that the lower-cased text holds, else null."""
    low = F.lower(text)
    return F.coalesce(*(F.when(low.contains(p), F.lit(p)) for p in phrases), F.lit(None).cast("string"))


def marker(value: Column, category: str) -> Column:
    return F.concat(F.lit(f"[REDACTED:{category}:"), F.substring(F.sha2(value.cast("binary"), 256), 1, 8), F.lit("]"))


def redact(text: Column, pattern: str, category: str) -> Column:
    """Each match of pattern (no groups) as its marker: the texts between, joined with the matches' markers."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    rest = F.split(text, pattern, -1)
    tail = F.zip_with(found, F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0))), lambda f, r: F.concat(marker(f, category), r))
    return F.when(F.size(found) == 0, text).otherwise(F.concat(rest[0], F.array_join(tail, "")))


def is_placeholder(value: Column) -> Column:
    """A credential that is none: says so, or runs on with one character."""
    return value.rlike(r"(?i)example|placeholder|changeme|redacted|dummy|your[_-]") | value.rlike(r"(.)\1{5}")


#: Credential literals by kind; the first group is the value.
CREDENTIALS = {
    "assigned": r"(?i)\b(?:token|secret|password|api[_-]?key)\s*[=:]\s*[\"']([^\"'\s]{12,})[\"']",
    "access_key": r"\b(AKIA[0-9A-Z]{16})\b",
    "private_key": r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)",
}


def credentials(text: Column) -> Column:
    """The different credential literals of a text, placeholders left out: an array of (kind, value), empty for null."""

    def of(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return F.array_distinct(F.filter(F.concat(*(of(k, p) for k, p in CREDENTIALS.items())), lambda x: ~is_placeholder(x["value"])))


def printable(text: Column) -> Column:
    """Without control, direction and invisible characters; tab and line end stay."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F​-‏‪-‮⁠-⁩﻿]", "")


def within_one_edit(a: Column, b: Column) -> Column:
    """Equal, or one character put in, left out or changed, or two neighbours swapped."""
    swapped = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b)
    return (F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & swapped)


def osa(a: Column, b: Column) -> Column:
    """Optimal string alignment distance: the least number of characters put in, left out or changed and neighbours swapped, none edited twice."""

    def cell(i: Column, j: Column, row: Column, last: Column, before: Column) -> Column:
        x, y = F.substr(a, i, F.lit(1)), F.substr(b, j, F.lit(1))
        swapped = F.when((i > 1) & (j > 1) & (x == F.substr(b, j - 1, F.lit(1))) & (F.substr(a, i - 1, F.lit(1)) == y), F.get(before, j - 2) + 1)
        return F.least(F.element_at(row, -1) + 1, F.get(last, j) + 1, F.get(last, j - 1) + (x != y).cast("int"), swapped)

    def line(s: Column, i: Column) -> Column:
        row = F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(i), lambda r, j: F.concat(r, F.array(cell(i, j, r, s["last"], s["before"]))))
        return F.struct(s["last"].alias("before"), row.alias("last"))

    start = F.struct(F.array().cast("array<int>").alias("before"), F.sequence(F.lit(0), F.length(b)).alias("last"))
    whole = F.aggregate(F.sequence(F.lit(1), F.length(a)), start, line, lambda s: F.element_at(s["last"], -1))
    return F.when(F.length(a) == 0, F.length(b)).when(F.length(b) == 0, F.length(a)).otherwise(whole)


def host_of(destination: Column) -> Column:
    """Lower-cased host of host:port, without a dot at its end."""
    return F.regexp_replace(F.regexp_replace(F.lower(destination), r"(?<=.):[^:\]]*\z", ""), r"\.\z", "")


def host_under(host: Column, domain: Column) -> Column:
    """The domain itself or a name under it."""
    return (host_of(host) == domain) | F.endswith(host_of(host), F.concat(F.lit("."), domain))


def holds_domain(text: Column, domain: str) -> Column:
    """The domain stands in the text as a whole name or the end of one; a dot behind it may only end a sentence."""
    return F.lower(text).rlike(r"(?<![a-z0-9_-])\Q" + domain + r"\E(?![a-z0-9_-]|\.[a-z0-9_-])")


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based identifier (version 5) of a name's UTF-8 bytes."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    h = F.sha1(F.concat(space, name.cast("binary")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


#: What clients write where a call didn't run, by whose decision.
REFUSALS = {
    "user": r"(?i)doesn'?t want to proceed with this tool use|tool use was rejected|user rejected tool use",
    "rule": r"(?i)permission to use \S+.{0,200}?(?:has been|was) denied",
    "not granted": r"(?i)this command requires approval|requested permissions? to use .{0,160}haven'?t granted|MCP request blocked",
}


def refusal(result: Column) -> Column:
    """Who refused a call by its result's text: user, rule or not granted; null for none of them."""
    return F.coalesce(*(F.when(result.rlike(p), F.lit(k)) for k, p in REFUSALS.items()))


#: Lines that clients write in a person's name.
AUTOMATIC = r"^\s*(?:\[Request interrupted|<command-|<local-command|Caveat: |<system-reminder>|This session is being continued)"


def is_instruction(kind: Column, text: Column) -> Column:
    """A person's prompt, unless a client wrote it, or an agent's message to another."""
    return (kind == "agent_message") | ((kind == "human_prompt") & ~F.coalesce(text, F.lit("")).rlike(AUTOMATIC))


#: Services that pass data on, by kind.
SERVICES = {
    "shortener": ("bit.ly", "tinyurl.com", "is.gd", "v.gd", "t.co", "rebrand.ly", "cutt.ly", "shorturl.at", "tiny.cc", "ow.ly", "buff.ly", "rb.gy", "t.ly", "s.id", "shorturl.gg", "clck.ru", "urlz.fr", "surl.li", "goo.su"),
    "screenshot": ("s.wordpress.com", "s0.wp.com", "urlbox.io", "api.screenshotone.com", "screenshotapi.net", "htmlcsstoimg.com", "hcti.io", "image.thum.io", "api.apiflash.com", "shot.screenshotapi.net", "render-tron.appspot.com"),
    "request-bin": ("webhook.site", "requestbin.com", "requestbin.net", "pipedream.net", "beeceptor.com", "hookbin.com", "requestcatcher.com", "interact.sh", "oast.fun", "oast.pro", "oast.live", "oast.site", "oast.online", "oast.me", "oastify.com", "burpcollaborator.net", "dnslog.cn", "canarytokens.com", "httpbin.org", "httpbun.com", "postb.in", "ptsv3.com"),
    "serverless-edge": ("workers.dev", "pages.dev", "vercel.app", "netlify.app", "deno.dev", "script.google.com", "script.googleusercontent.com", "glitch.me", "repl.co", "onrender.com", "fly.dev", "herokuapp.com"),
    "blockchain-rpc": ("infura.io", "alchemy.com", "alchemyapi.io", "nodereal.io", "getblock.io", "llamarpc.com", "cloudflare-eth.com", "ankr.com", "quicknode.pro", "publicnode.com", "api.trongrid.io", "mainnet.helius-rpc.com", "api.mainnet-beta.solana.com"),
    "tunnel": ("trycloudflare.com", "ngrok.io", "ngrok-free.app", "ngrok.app", "ngrok-free.dev", "loca.lt", "serveo.net", "localhost.run", "lhr.life", "pinggy.link", "bore.pub", "localtonet.com", "tunnelmole.net"),
    "paste": ("pastebin.com", "paste.ee", "hastebin.com", "ghostbin.com", "rentry.co", "rentry.org", "dpaste.org", "dpaste.com", "termbin.com", "transfer.sh", "0x0.st", "file.io", "gofile.io", "catbox.moe", "litterbox.catbox.moe", "tmpfiles.org", "bashupload.com", "temp.sh", "oshi.at", "pixeldrain.com"),
    "chat-webhook": ("discord.com", "discordapp.com", "api.telegram.org", "hooks.slack.com"),
}


def service_category(destination: Column) -> Column:
    """The kind of service that a host, with or without port, belongs to; null for none."""
    host = host_of(destination)
    return F.coalesce(*(F.when(is_allowed(host, names), F.lit(k)) for k, names in SERVICES.items()))
