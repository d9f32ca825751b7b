"""Command line: ``python -m loregraph.cli extract|build|generate|index|query|serve ...``."""

from __future__ import annotations

import argparse
import json
import logging

from loregraph.operators import nodes
from loregraph.plans import pipeline
from loregraph.session import local_session


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loregraph")
    p.add_argument("--cpus", default="8")
    sub = p.add_subparsers(dest="verb", required=True)
    x = sub.add_parser("extract", help="read a source tree into documents")
    x.add_argument("root"), x.add_argument("out"), x.add_argument("--repo", default="local"), x.add_argument("--dry-run", action="store_true")
    for verb, what in (("build", "nodes and edges from documents"), ("generate", "text about files and modules")):
        y = sub.add_parser(verb, help=what)
        y.add_argument("docs"), y.add_argument("out")
    q = sub.add_parser("query", help="candidates for a question, from a folder of tables")
    q.add_argument("folder"), q.add_argument("question"), q.add_argument("--index")
    i = sub.add_parser("index", help="keep the keyword index of a folder of tables")
    i.add_argument("folder"), i.add_argument("out")
    v = sub.add_parser("serve", help="answer over HTTP")
    v.add_argument("folder"), v.add_argument("--repo"), v.add_argument("--port", type=int, default=8080), v.add_argument("--index")
    p.add_argument("--quiet", action="store_true", help="errors only"), p.add_argument("--verbose", action="store_true", help="each step")
    a = p.parse_args(args)
    logging.basicConfig(format="%(message)s", level=logging.ERROR if a.quiet else logging.DEBUG if a.verbose else logging.INFO)
    logging.getLogger("py4j").setLevel(logging.ERROR)
    spark = local_session(a.cpus)
    log = logging.getLogger("loregraph")
    if a.verb == "extract":
        docs = pipeline.extract(spark, a.root, a.repo)
        if a.dry_run:
            print("\n".join(r.path for r in docs.select("path").orderBy("path").collect()))
            return 0
        docs.write.mode("overwrite").parquet(a.out)
        for r in spark.read.parquet(a.out).where("error IS NOT NULL").select("error").collect():
            log.warning(r.error)
    elif a.verb == "build":
        docs = spark.read.parquet(a.docs)
        pipeline.functions(docs).write.mode("overwrite").parquet(f"{a.out}/functions")
        pipeline.edges(docs).write.mode("overwrite").parquet(f"{a.out}/edges")
        pipeline.cross_calls(docs).write.mode("overwrite").parquet(f"{a.out}/calls")
        pipeline.patterns(docs).write.mode("overwrite").parquet(f"{a.out}/patterns")
        files = docs.select("repo", "path", "lines")
        nodes.Store(spark, f"{a.out}/kept").put(nodes.file_nodes(files).unionByName(nodes.function_nodes(pipeline.functions(docs))).unionByName(nodes.modules(files)))
    elif a.verb == "generate":
        pipeline.prose(spark.read.parquet(a.docs)).write.mode("overwrite").parquet(a.out)
    else:
        from loregraph.api import Engine

        if a.verb == "index":
            Engine(spark, a.folder).build_index(a.out)
        elif a.verb == "serve":
            from loregraph.server import serve

            log.info("listening on port %s", a.port)
            serve(Engine(spark, a.folder, a.index), a.port, a.repo).serve_forever()
        else:
            print(json.dumps(Engine(spark, a.folder, a.index).query(a.question), indent=1))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
