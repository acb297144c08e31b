"""Exchange configuration: `key = value` lines to reference data, with a canonical form."""

from __future__ import annotations

import hashlib
import re

_ONCE = {"ledger_shards", "matching_groups", "partitions", "fee_ppm", "credit_epoch"}


class ConfigError(ValueError):
    pass


def _number(line: int, key: str, value: str, most: int = (1 << 64) - 1) -> int:
    if not re.fullmatch(r"\d+", value.strip()) or int(value) > most:
        raise ConfigError(f"line {line}: {key}: `{value}` is no valid number here")
    return int(value)


def parse(text: str) -> dict:
    """ledger_shards, matching_groups, partitions, fee_ppm, credit (groups, epoch) or None, symbols."""
    out: dict = {"credit_groups": [], "symbols": {}}
    for n, raw in enumerate(text.splitlines(), 1):
        line = raw.split("#", 1)[0].strip()
        if not line:
            continue
        if "=" not in line:
            raise ConfigError(f"line {n}: expected `key = value`, found `{line}`")
        key, value = (x.strip() for x in line.split("=", 1))
        if key in _ONCE:
            if key in out:
                raise ConfigError(f"line {n}: `{key}` is set twice")
            out[key] = _number(n, key, value)
        elif key == "credit_group":
            for g in value.split(","):
                g = _number(n, key, g)
                if g in out["credit_groups"]:
                    raise ConfigError(f"line {n}: credit group {g} is listed twice")
                out["credit_groups"].append(g)
        elif key == "symbol":
            head, *pairs = value.split()
            sid, fields = _number(n, key, head, (1 << 32) - 1), {}
            for p in pairs:
                k, _, v = p.partition("=")
                if k not in ("base", "quote", "lot", "maker_ppm", "taker_ppm") or k in fields:
                    raise ConfigError(f"line {n}: `{p}` is not understood")
                fields[k] = _number(n, k, v)
            if sid in out["symbols"] or not {"base", "quote", "lot"} <= set(fields) or ("maker_ppm" in fields) != ("taker_ppm" in fields):
                raise ConfigError(f"line {n}: symbol {sid} is listed twice or incomplete")
            out["symbols"][sid] = fields
        else:
            raise ConfigError(f"line {n}: unknown key `{key}`")
    missing = _ONCE - {"credit_epoch"} - set(out)
    if missing:
        raise ConfigError(f"missing: {', '.join(sorted(missing))}")
    out["credit_groups"].sort()
    return out | {"credit_epoch": out.get("credit_epoch", 1)}


def canonical(c: dict, tag: str = "exchange-config/1") -> str:
    rows = [tag, *[f"{k}={c[k]}" for k in ("ledger_shards", "matching_groups", "partitions", "fee_ppm")]]
    if c["credit_groups"]:
        rows += [*[f"credit_group={g}" for g in c["credit_groups"]], f"credit_epoch={c['credit_epoch']}"]
    for s in sorted(c["symbols"]):
        y = c["symbols"][s]
        rows.append(f"symbol={s} base={y['base']} quote={y['quote']} lot={y['lot']}" + (f" maker_ppm={y['maker_ppm']} taker_ppm={y['taker_ppm']}" if "maker_ppm" in y else ""))
    return "\n".join(rows) + "\n"


def checksum(c: dict, tag: str = "exchange-config/1") -> str:
    return hashlib.sha256(canonical(c, tag).encode()).hexdigest()
