"""Adapters for deployment configuration: Kubernetes, Serverless, Zappa, Apache, and queue addresses anywhere in it.

Each reads one file and yields findings as `extract` defines them. YAML needs
its parser; without it a file that looks like one of these is a coverage row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import PurePosixPath

Finding = tuple[str, str, str, str, str, str | None, int, int]

# Fixed values that results depend on.
WORKLOADS = ("Deployment", "StatefulSet", "DaemonSet", "ReplicaSet", "Job", "CronJob", "Pod")
SQS_ARN = re.compile(r"arn:aws[a-z-]*:sqs:[a-z0-9-]+:[0-9]{12}:([A-Za-z0-9_-]{1,75}(?:\.fifo)?)(?![A-Za-z0-9_.-])")
SNS_ARN = re.compile(r"arn:aws[a-z-]*:sns:[a-z0-9-]+:[0-9]{12}:([A-Za-z0-9_-]{1,251}(?:\.fifo)?)(?![A-Za-z0-9_.:-])")
SQS_URL = re.compile(r"https://sqs\.[a-z0-9-]+\.amazonaws\.com/[0-9]{12}/([A-Za-z0-9_-]{1,75}(?:\.fifo)?)(?![A-Za-z0-9_./-])")
DOMAIN = re.compile(r"(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}")


def _fact(predicate: str, kind: str, subject: str, obj: str, line: int, detail: str | None = None) -> Finding:
    return "fact", predicate, kind, subject, obj, detail, line, line


def _gap(reason: str) -> Finding:
    return "coverage", "", "", "", reason, None, 0, 0


def _line(text: str, needle: str) -> int:
    at = text.find(needle)
    return text.count("\n", 0, at) + 1 if at >= 0 else 1


def _channels(text: str) -> Iterator[tuple[str, int]]:
    for broker, pattern in (("sqs", SQS_ARN), ("sns", SNS_ARN), ("sqs", SQS_URL)):
        for found in pattern.finditer(text):
            yield f"{broker}:{found[1]}", text.count("\n", 0, found.start()) + 1


def _yaml(text: str) -> list | None:
    """All documents of a file, or null where there is no parser."""
    try:
        import yaml
    except ImportError:
        return None
    try:
        return [d for d in yaml.safe_load_all(text) if isinstance(d, dict)]
    except yaml.YAMLError as error:
        raise ValueError(str(error)) from error


def _at(value: object, *path: str) -> object:
    for key in path:
        value = value.get(key) if isinstance(value, dict) else None
    return value


def kubernetes(path: str, text: str) -> Iterator[Finding]:
    """Workloads, and the domains that an ingress routes to them by way of a service's selector."""
    if not re.search(r"^\s*kind:", text, re.M) or not re.search(r"^\s*apiVersion:", text, re.M):
        return
    docs = _yaml(text)
    if docs is None:
        yield _gap("yaml_parser_unavailable")
        return
    space = lambda d: str(_at(d, "metadata", "namespace") or "default")
    name = lambda d: str(_at(d, "metadata", "name") or "")
    workloads, services = [], {}
    for d in docs:
        if d.get("kind") in WORKLOADS:
            pod = d if d["kind"] == "Pod" else _at(d, "spec", "jobTemplate", "spec", "template") if d["kind"] == "CronJob" else _at(d, "spec", "template")
            labels = _at(pod, "metadata", "labels")
            target = f"kubernetes_{d['kind'].lower()}:{space(d)}/{name(d)}"
            workloads.append((space(d), labels if isinstance(labels, dict) else {}, target))
            yield _fact("DEPLOYS_VIA_CONFIG", "DeployTarget", "", target, _line(text, name(d)))
        elif d.get("kind") == "Service":
            services[space(d), name(d)] = _at(d, "spec", "selector")
    for d in docs:
        rules = _at(d, "spec", "rules") if d.get("kind") == "Ingress" else None
        for rule in rules if isinstance(rules, list) else ():
            host = str(_at(rule, "host") or "").lower()
            if not DOMAIN.fullmatch(host):
                continue
            yield _fact("REFERENCES_DOMAIN", "Domain", "", host, _line(text, host), "kubernetes_ingress")
            paths = _at(rule, "http", "paths")
            backends = {str(_at(p, "backend", "service", "name") or _at(p, "backend", "serviceName") or "") for p in paths} if isinstance(paths, list) else set()
            for backend in sorted(backends):
                wanted = services.get((space(d), backend))
                for where, labels, target in workloads:
                    if isinstance(wanted, dict) and wanted and where == space(d) and all(labels.get(k) == v for k, v in wanted.items()):
                        yield _fact("ROUTES_DOMAIN_TO_DEPLOY", "DeployTarget", host, target, _line(text, host), backend)


def serverless(path: str, text: str) -> Iterator[Finding]:
    """HTTP routes, websocket routes and queues of a Serverless file's functions."""
    if not re.fullmatch(r"serverless[\w.-]*\.ya?ml", PurePosixPath(path).name):
        return
    docs = _yaml(text)
    if docs is None:
        yield _gap("yaml_parser_unavailable")
        return
    functions = docs[0].get("functions") if docs else None
    for name, function in functions.items() if isinstance(functions, dict) else ():
        events = _at(function, "events")
        for event in events if isinstance(events, list) else ():
            for kind in ("http", "httpApi"):
                http = _at(event, kind)
                if isinstance(http, str) and len(http.split()) == 2:
                    http = dict(zip(("method", "path"), http.split()))
                if isinstance(http, dict) and isinstance(http.get("path"), str):
                    route = "/" + http["path"].strip("/")
                    method = str(http.get("method") or "any").upper()
                    yield _fact("EXPOSES_ENDPOINT", "Endpoint", str(name), f"{'ANY' if method == '*' else method} {route}", _line(text, http["path"]))
            socket = _at(event, "websocket")
            route = socket if isinstance(socket, str) else _at(socket, "route")
            if isinstance(route, str):
                yield _fact("EXPOSES_ENDPOINT", "Endpoint", str(name), f"WEBSOCKET {route}", _line(text, route))
                yield _fact("CONSUMES_EVENT", "EventChannel", str(name), f"websocket:{route}", _line(text, route))
            for kind in ("sqs", "sns", "stream"):
                given = _at(event, kind)
                arn = given if isinstance(given, str) else _at(given, "arn")
                for channel, _ in _channels(arn) if isinstance(arn, str) else ():
                    yield _fact("CONSUMES_EVENT", "EventChannel", str(name), channel, _line(text, arn))


def zappa(path: str, text: str) -> Iterator[Finding]:
    """Stages with an application, their domains, and the queues they consume."""
    if not re.fullmatch(r"zappa_settings[\w.-]*\.json", PurePosixPath(path).name):
        return
    try:
        data = json.loads(text)
    except ValueError:
        yield _gap("zappa_parse_error")
        return
    for stage, config in data.items() if isinstance(data, dict) else ():
        app = _at(config, "app_function")
        if isinstance(app, str) and app.strip():
            target = f"zappa_lambda:{stage}:{app.strip()}"
            yield _fact("DEPLOYS_VIA_CONFIG", "DeployTarget", "", target, _line(text, app))
            domain = str(_at(config, "domain") or "").lower()
            if DOMAIN.fullmatch(domain):
                yield _fact("REFERENCES_DOMAIN", "Domain", "", domain, _line(text, domain), "zappa_domain")
                yield _fact("ROUTES_DOMAIN_TO_DEPLOY", "DeployTarget", domain, target, _line(text, domain))
        events = _at(config, "events")
        for event in events if isinstance(events, list) else ():
            arn = _at(event, "event_source", "arn")
            if isinstance(arn, str) and (found := SQS_ARN.fullmatch(arn)):
                yield _fact("CONSUMES_EVENT", "EventChannel", str(_at(event, "function") or ""), f"sqs:{found[1]}", _line(text, arn))


def apache(path: str, text: str) -> Iterator[Finding]:
    """Names of virtual hosts that run a WSGI script; blocks that do not close give nothing."""
    names: list[tuple[int, str]] = []
    scripts: list[str] = []
    inside = False
    for number, raw in enumerate(text.splitlines(), 1):
        words = re.sub(r"^((?:[^#'\"]|'[^']*'|\"[^\"]*\")*)#.*$", r"\1", raw).split()
        first = words[0].lower() if words else ""
        if first.startswith("<virtualhost"):
            names, scripts, inside = [], [], True
        elif first.startswith("</virtualhost") and inside:
            inside = False
            for line, domain in names if scripts else ():
                yield _fact("REFERENCES_DOMAIN", "Domain", "", domain, line, "apache_server_name")
                for script in scripts:
                    yield _fact("ROUTES_DOMAIN_TO_DEPLOY", "DeployTarget", domain, f"wsgi:{script}", line)
        elif inside and first == "servername":
            names.extend((number, w.strip("'\"")) for w in words[1:2])
        elif inside and first == "serveralias":
            names.extend((number, w.strip("'\"")) for w in words[1:])
        elif inside and first == "wsgiscriptalias" and len(words) >= 3:
            scripts.append(words[2].strip("'\""))


def channels(path: str, text: str) -> Iterator[Finding]:
    """Queue and topic addresses in configuration, and queue names in INI files; each channel once a file."""
    found = dict(reversed([*_channels(text)]))
    if path.endswith(".ini"):
        for number, line in enumerate(text.splitlines(), 1):
            name = re.fullmatch(r"\s*[\w.-]*queue[\w.-]*\s*[=:]\s*([A-Za-z0-9_-]{1,75}(?:\.fifo)?)\s*", line)
            if name:
                found.setdefault(f"sqs:{name[1]}", number)
    for channel, line in sorted(found.items()):
        yield _fact("REFERENCES_EVENT_CHANNEL", "EventChannel", "", channel, line)


def terraform(path: str, text: str) -> Iterator[Finding]:
    """Literal domain names of record and distribution blocks, and queues that event source mappings name."""
    clean = re.sub(r"(?m)(#|//)[^\n\"]*$", "", text)
    for number, line in enumerate(clean.splitlines(), 1):
        for value in re.findall(r"^\s*(?:name|domain_name|zone_name)\s*=\s*\"([^\"$]+)\"", line):
            if DOMAIN.fullmatch(value.lower().rstrip(".")):
                yield _fact("REFERENCES_DOMAIN", "Domain", "", value.lower().rstrip("."), number, "terraform_literal")
        for arn in re.findall(r"^\s*event_source_arn\s*=\s*\"([^\"]+)\"", line):
            if found := SQS_ARN.fullmatch(arn):
                yield _fact("CONSUMES_EVENT", "EventChannel", "", f"sqs:{found[1]}", number)
