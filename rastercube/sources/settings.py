"""Access to object stores: settings for Spark's S3 reader, discovery of regions and credentials, and redaction.

Executors get Spark's settings by themselves, so nothing is captured and restored per task.
"""

from __future__ import annotations

import os
import random
import re
import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tiff import TiffReader

#: Names of settings that hold secrets, and those that belong to a session beside them.
SECRETS = (
    "AWS_ACCESS_KEY_ID", "AWS_SECRET_ACCESS_KEY", "AWS_SESSION_TOKEN", "AZURE_STORAGE_CONNECTION_STRING", "AZURE_STORAGE_ACCESS_TOKEN",
    "AZURE_STORAGE_ACCESS_KEY", "AZURE_STORAGE_SAS_TOKEN", "AZURE_SAS", "GS_ACCESS_KEY_ID", "GS_SECRET_ACCESS_KEY", "OSS_ACCESS_KEY_ID",
    "OSS_SECRET_ACCESS_KEY", "SWIFT_AUTH_TOKEN",
)
SESSION = (
    "AWS_DEFAULT_REGION", "AWS_REGION", "AWS_S3_ENDPOINT", "AWS_NO_SIGN_REQUEST", "AWS_REQUEST_PAYER", "AWS_WEB_IDENTITY_TOKEN_FILE",
    "AZURE_STORAGE_ACCOUNT", "AZURE_NO_SIGN_REQUEST", "OSS_ENDPOINT", "SWIFT_STORAGE_URL",
)
#: The same in the names of Spark's S3 reader.
S3A_SECRETS = ("fs.s3a.access.key", "fs.s3a.secret.key", "fs.s3a.session.token")
S3A_SESSION = ("fs.s3a.endpoint", "fs.s3a.endpoint.region", "fs.s3a.requester.pays.enabled")
CLOUD_DEFAULTS = {"fs.s3a.attempts.maximum": "10", "fs.s3a.retry.limit": "10", "fs.s3a.retry.interval": "500ms", "fs.s3a.experimental.input.fadvise": "random"}


def truthy(text: str | None) -> bool:
    return (text or "").strip().upper() in {"YES", "Y", "TRUE", "T", "1"}


def unsigned_by_env(env: Mapping[str, str] | None = None) -> bool:
    return truthy((env or os.environ).get("AWS_NO_SIGN_REQUEST"))


def find_region(env: Mapping[str, str] | None = None, probe: Callable[[], str | None] | None = None, default: str | None = None) -> str:
    """Region from the environment, else from ``probe`` (an instance's metadata), else the default; fails with none."""
    env = env if env is not None else os.environ
    found = env.get("AWS_REGION") or env.get("AWS_DEFAULT_REGION") or (probe() if probe else None) or default
    if not found:
        raise ValueError("Region is not known: give one")
    return found


def with_retry(get: Callable[[], object | None], attempts: int = 10, first: float = 0.1, most: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> object | None:
    """Call until there is a result; waits double up to ``most`` seconds, with some jitter."""
    wait = first
    for k in range(attempts):
        if (got := get()) is not None:
            return got
        if k + 1 < attempts:
            sleep(wait * (1 + random.random() / 10))
            wait = min(most, 2 * wait)
    return None


def s3_settings(*, profile: str | None = None, region_name: str | None = "auto", aws_unsigned: bool | None = None, requester_pays: bool = False, cloud_defaults: bool = True, env: Mapping[str, str] | None = None, credentials: Mapping[str, str] | None = None, **more: str) -> dict[str, str]:
    """Settings ``spark.hadoop.fs.s3a.*`` for a session builder."""
    out = dict(CLOUD_DEFAULTS) if cloud_defaults else {}
    if aws_unsigned is None:
        aws_unsigned = unsigned_by_env(env)
    if region_name == "auto":
        try:
            region_name = find_region(env)
        except ValueError:
            region_name = None
    if region_name:
        out["fs.s3a.endpoint.region"] = region_name
    if requester_pays:
        out["fs.s3a.requester.pays.enabled"] = "true"
    if aws_unsigned:
        out["fs.s3a.aws.credentials.provider"] = "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"
    elif credentials:
        out |= {"fs.s3a.access.key": credentials["key"], "fs.s3a.secret.key": credentials["secret"]}
        if credentials.get("token"):
            out["fs.s3a.session.token"] = credentials["token"]
            out["fs.s3a.aws.credentials.provider"] = "org.apache.hadoop.fs.s3a.TemporaryAWSCredentialsProvider"
    elif profile:
        out["fs.s3a.aws.credentials.provider"] = "software.amazon.awssdk.auth.credentials.ProfileCredentialsProvider"
        out["fs.s3a.profile"] = profile
    return {f"spark.hadoop.{k}": v for k, v in (out | more).items()}


def _bare(name: str) -> str:
    return re.sub(r"^spark\.hadoop\.", "", name).upper()


_SECRET = {x.upper() for x in (*SECRETS, *S3A_SECRETS)}
_SESSION = _SECRET | {x.upper() for x in (*SESSION, *S3A_SESSION)}


def sanitize(settings: Mapping[str, str], *, no_session_keys: bool = False) -> dict[str, str]:
    """Settings with secrets masked; with ``no_session_keys`` all that belong to a session are left out."""
    return {k: "xx..xx" if _bare(k) in _SECRET else v for k, v in settings.items() if not (no_session_keys and _bare(k) in _SESSION)}


def sanitized(settings: DataFrame, *, no_session_keys: bool = False) -> DataFrame:
    """The same for a table (name, value)."""
    bare = F.upper(F.regexp_replace("name", r"^spark\.hadoop\.", ""))
    kept = settings.where(~bare.isin(*sorted(_SESSION))) if no_session_keys else settings
    return kept.withColumn("value", F.when(bare.isin(*sorted(_SECRET)), "xx..xx").otherwise(F.col("value")))


#: Readers of pixels by name of a format (see ``plans.read`` for what a reader is).
READERS: dict[str, object] = {"tiff": TiffReader()}


def register_reader(name: str, reader) -> None:
    READERS[name] = reader


def reader_for(name=None):
    """A reader by name, a reader itself, or that of TIFF files."""
    if name is not None and not isinstance(name, str):
        return name
    try:
        return READERS[name or "tiff"]
    except KeyError:
        raise ValueError(f"No reader is registered as {name!r}") from None
