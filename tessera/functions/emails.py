"""Addresses: sets they belong to, checks and parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Desk names, form placeholders, free and disposable mail.
ROLES = (
    "info", "enquiry", "enquiries", "admin", "contact", "sales", "support", "hello", "ask", "help", "general", "office", "mail", "marketing",
    "hr", "careers", "jobs", "compliance", "legal", "finance", "accounts", "billing", "service", "customercare", "advice", "team", "partners",
    "no-reply", "noreply", "donotreply", "webmaster", "postmaster", "abuse", "privacy", "dpo", "feedback", "invest", "client", "clients",
    "claims", "pdpa", "mypersonaldata", "personaldata", "marketconduct", "chru", "complaints", "whistleblowing", "audit", "risk", "operations", "ops", "reception", "training",
)
PLACEHOLDER_DOMAINS = ("domain.com", "example.com", "example.org", "email.com", "yourdomain.com", "company.com", "gmail.co", "abc.com")
PLACEHOLDER_LOCALS = ("user", "username", "yourname", "your-name", "name", "email", "youremail", "firstname", "lastname", "someone", "test")
FREE_MAIL = (
    "gmail.com", "yahoo.com", "yahoo.com.sg", "hotmail.com", "outlook.com", "live.com", "icloud.com", "me.com", "qq.com", "163.com",
    "proton.me", "protonmail.com", "mailhutch.example", "postnook.example", "letterloft.test",
)
DISPOSABLE = ("mailinator.com", "guerrillamail.com", "10minutemail.com", "tempmail.com", "trashmail.com", "yopmail.com", "sharklasers.com", "throwawaymail.com")
SYNTAX = r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$"


def tidy(email: Column) -> Column:
    return F.lower(F.regexp_replace(email, r"^\s+|\s+$", ""))


def local(email: Column) -> Column:
    return F.substring_index(email, "@", 1)


def domain(email: Column) -> Column:
    return F.when(email.contains("@"), F.regexp_extract(email, "@(.*)$", 1))


def is_role(local_part: Column, roles: Sequence[str] = ROLES) -> Column:
    """The whole local part or its first piece is a desk's name."""
    low = F.lower(local_part)
    return low.isin(*roles) | F.element_at(F.split(low, r"[.\-_+]"), 1).isin(*roles)


def is_placeholder(email: Column, domains: Sequence[str] = PLACEHOLDER_DOMAINS, locals_: Sequence[str] = PLACEHOLDER_LOCALS) -> Column:
    low = F.lower(email)
    return domain(low).isin(*domains) | local(low).isin(*locals_)


def is_free(domain_part: Column, free: Sequence[str] = FREE_MAIL) -> Column:
    return domain_part.isin(*free)


def registrable(host: Column) -> Column:
    """Last two labels, three where the last has two letters and the one before is a general one."""
    parts = F.split(F.regexp_replace(F.lower(host), r"^\.+", ""), r"\.")
    n = F.size(parts)
    three = (n >= 3) & F.try_element_at(parts, F.lit(-2)).isin("com", "net", "org", "edu", "gov", "co") & (F.length(F.try_element_at(parts, F.lit(-1))) == 2)
    keep = F.when(three, 3).otherwise(2)
    return F.when(n >= 2, F.array_join(F.slice(parts, F.greatest(n - keep + 1, F.lit(1)), keep), ".")).otherwise(host)
