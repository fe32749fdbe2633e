"""Small sequential models the operators are compared with on random inputs."""

from __future__ import annotations

import re

SPACES = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + (
    "    　"
)


def decode(data: bytes) -> str:
    return data.decode("utf-8", "surrogateescape")


def encode(text: str) -> bytes:
    return text.encode("utf-8", "surrogateescape")


def tokens(data: bytes) -> int:
    return len(re.findall(f"[^{SPACES}]+", decode(data)))


def trim(data: bytes) -> bytes:
    return encode(decode(data).strip(SPACES))


def strip_comments(data: bytes) -> bytes:
    raw = data.split(b"\n")
    if raw[-1] == b"":
        raw.pop()
    if any(len(line) >= 65536 for line in raw):
        return data
    kept: list[str] = []  # "" stands for one blank line
    opened = False
    for line in map(decode, raw):
        line = line[:-1] if line.endswith("\r") else line
        if not line.strip(SPACES):
            if not kept or kept[-1] != "":
                kept.append("")
            continue
        indent = line[: len(line) - len(line.lstrip(" \t"))]
        cut = False
        if opened:
            if "*/" not in line:
                continue
            line, opened, cut = line.partition("*/")[2], False, True
        head, mark, _ = line.partition("/*")
        if mark:
            line, opened, cut = head, True, True
        head, mark, _ = line.partition("//")
        if mark:
            line, cut = head, True
        if cut:
            line = line.strip(SPACES)
            if not line:
                continue
            line = indent + line
        kept.append(line)
    text = "\n".join(kept)
    if kept and kept[0] == "":
        text = "\n" + text
    return encode(text.rstrip("\n"))


def windows(n: int, size: int, overlap: int) -> list[tuple[int, int]]:
    if n <= size:
        return [(0, n)]
    out, at = [], 0
    while at < n:
        end = min(n, at + size)
        out.append((at, end))
        at += max(1, end - at - overlap)
        if at < n and n - at <= overlap:
            out.append((at, n))
            break
    return out


def segments(data: bytes) -> list[bytes]:
    out = []
    while data:
        end = data.find(b">") + 1 if data.startswith(b"<") else 0
        if end:
            end += data[end : end + 1] == b"\n"
        else:
            end = (data.find(b"\n") + 1) or len(data)
        out.append(data[:end])
        data = data[end:]
    return out


def packs(parts: list[bytes], size: int, max_tokens: int) -> list[bytes]:
    out: list[list[bytes]] = []
    for part in parts:
        now = out[-1] if out else []
        full = bool(size) and sum(map(len, now)) >= size
        full |= bool(max_tokens) and sum(map(tokens, now)) + tokens(part) > max_tokens
        if not now or full:
            out.append([])
        out[-1].append(part)
    return [b"".join(p) for p in out]
