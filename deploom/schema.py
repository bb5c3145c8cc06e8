"""Explicit schemas; nothing is inferred."""

from __future__ import annotations

SOURCE = "struct<files:bigint,binary:bigint,size:bigint,lines:bigint,blank:bigint>"
MODULE = "struct<path:string,version:string,main:boolean,dir:string,replace:struct<path:string,version:string>>"
STAT = f"struct<package_count:bigint,go:{SOURCE},other_files:{SOURCE},decls:struct<func:bigint,type:bigint,const:bigint,var:bigint,other:bigint>,tokens:struct<code:bigint,comment:bigint,basic:bigint>>"

PACKAGES = f"variant string, id string, name string, pkg_path string, module {MODULE}, is_std boolean, go_files array<string>, compiled_go_files array<string>, other_files array<string>, ignored_files array<string>, export_file string, errors array<string>"
IMPORTS = "variant string, src_id string, import_path string, dst_id string"
PACKAGE_STATS = f"variant string, id string, stat {STAT}, errors array<string>"
SYMBOLS = "binary string, line_no bigint, addr decimal(20,0), size bigint, code string, qualified_name string, info string, path array<string>, name string"
RUSAGE = ("maxrss", "ixrss", "idrss", "isrss", "minflt", "majflt", "nswap", "inblock", "oublock", "msgsnd", "msgrcv", "nsignals", "nvcsw", "nivcsw")
EXEC_LOG = "args array<string>, start timestamp, finish timestamp, user_ns bigint, system_ns bigint, exit_status int, has_usage boolean, " + ", ".join(f"{c} bigint" for c in RUSAGE)

#: Flat names of the additive statistics, and where they sit in a node record.
STAT_FIELDS = {
    "package_count": "PackageCount",
    **{f"{a}_{b}": f"{c}.{d}" for a, c in (("go", "Go"), ("other", "OtherFiles")) for b, d in (("files", "Files"), ("binary", "Binary"), ("size", "Size"), ("lines", "Lines"), ("blank", "Blank"))},
    **{f"decl_{a.lower()}": f"Decls.{a}" for a in ("Func", "Type", "Const", "Var", "Other")},
    **{f"token_{a.lower()}": f"Tokens.{a}" for a in ("Code", "Comment", "Basic")},
}
