"""The rules that sort command-line tokens, as data.

The values below are fixed: they must be these for right results.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------

#: handler, number of following tokens it takes, flags
EXACT = [
    ("input_file", 0, "/dev/null"),
    ("print_only", 0, "-"),
    ("output_file", 1, "-o"),
    ("compile_only", 0, "-c --version -v"),
    ("preprocess_only", 0, "-E"),
    ("assemble_only", 0, "-S"),
    ("verbose", 0, "--verbose"),
    ("default_binary", 1, "--param -aux-info -Xpreprocessor -Xassembler -Xlinker"),
    ("compile_unary", 0, """
        -w -W -pipe -undef -nostdinc -nostdinc++ -Qunused-arguments -no-integrated-as -integrated-as -no-cpp-precomp
        -nostdlibinc -mno-omit-leaf-frame-pointer -maes -mno-aes -mavx -mno-avx -mavx2 -mno-avx2 -mno-red-zone -mmmx
        -mbmi -mbmi2 -mf161c -mfma -mno-mmx -mno-global-merge -mno-80387 -msse -mno-sse -msse2 -mno-sse2 -msse3
        -mno-sse3 -mssse3 -mno-ssse3 -msse4 -mno-sse4 -msse4.1 -mno-sse4.1 -msse4.2 -mno-sse4.2 -msoft-float -m3dnow
        -mno-3dnow -mstackrealign -mretpoline-external-thunk -mno-fp-ret-in-387 -mskip-rax-setup
        -mindirect-branch-register -ansi -pedantic -g -g0 -g1 -g2 -g3 -ggdb -ggdb0 -ggdb1 -ggdb2 -ggdb3 -gdwarf
        -gdwarf-2 -gdwarf-3 -gdwarf-4 -gline-tables-only -grecord-gcc-switches -ggnu-pubnames -p -pg -O -O0 -O1 -O2
        -O3 -Os -Ofast -Og -Oz -print-multi-directory -print-multi-lib -print-libgcc-file-name -print-search-dirs
    """),
    ("emit_llvm", 0, "-emit-llvm"),
    ("lto", 0, "-flto"),
    ("compile_link_unary", 0, "-no-canonical-prefixes -m16 -m32 -m64 -fprofile-arcs -coverage --coverage -fopenmp"),
    ("compile_link_binary", 1, "--sysroot"),
    ("link_unary", 0, "-pthread -shared -static -static-libgcc -pie -nostdlib -nodefaultlibs -rdynamic -dynamiclib"),
    ("compile_binary", 1, """
        -mllvm -A -D -U -arch -I -idirafter -include -imacros -iprefix -iwithprefix -iwithprefixbefore -isystem
        -isysroot -iquote -imultilib -x -Xclang
    """),
    ("compile_unary", 1, "-P -C"),
    ("dependency_only", 0, "-M -MM -MG -MP -MD -MV -MMD"),
    ("dependency_binary", 1, "-MF -MJ -MT -MQ"),
    ("link_binary", 1, "-l -L -T -u -install_name -e -rpath -current_version -compatibility_version"),
    ("warning_link_unary", 0, "-Wl,-dead_strip -dead_strip"),
]

#: First match wins.
PATTERNS = [
    (r"^-MF.*$", "compile_unary"),
    (r"^-MJ.*$", "compile_unary"),
    (r"^-MQ.*$", "compile_unary"),
    (r"^-MT.*$", "compile_unary"),
    (r"^-Wl,.+$", "link_unary"),
    (r"^-W[^l].*$", "compile_unary"),
    (r"^-W[l][^,].*$", "compile_unary"),
    (r"^-(l|L).+$", "link_unary"),
    (r"^-I.+$", "compile_unary"),
    (r"^-D.+$", "compile_unary"),
    (r"^-B.+$", "compile_link_unary"),
    (r"^-isystem.+$", "compile_link_unary"),
    (r"^-U.+$", "compile_unary"),
    (r"^-fsanitize=.+$", "compile_link_unary"),
    (r"^-fuse-ld=.+$", "link_unary"),
    (r"^-flto=.+$", "lto"),
    (r"^-f.+$", "compile_unary"),
    (r"^-rtlib=.+$", "link_unary"),
    (r"^-std=.+$", "compile_unary"),
    (r"^-stdlib=.+$", "compile_link_unary"),
    (r"^-mtune=.+$", "compile_unary"),
    (r"^--sysroot=.+$", "compile_link_unary"),
    (r"^-print-.*$", "compile_unary"),
    (r"^-mmacosx-version-min=.+$", "compile_link_unary"),
    (r"^-mstack-alignment=.+$", "compile_unary"),
    (r"^-march=.+$", "compile_unary"),
    (r"^-mregparm=.+$", "compile_unary"),
    (r"^-mcmodel=.+$", "compile_unary"),
    (r"^-mpreferred-stack-boundary=.+$", "compile_unary"),
    (r"^-mindirect-branch=.+$", "compile_unary"),
    (r"^--param=.+$", "compile_unary"),
    (r"^.+\.(c|cc|cpp|C|cxx|i|s|S|bc)$", "input_file"),
    (r"^.+\.([fF](|[0-9][0-9]|or|OR|pp|PP))$", "input_file"),
    (r"^.+\.(o|lo|So|so|po|a|dylib|pico|nossppico)$", "object_file"),
    (r"^.+\.dylib(\.\d)+$", "object_file"),
    (r"^.+\.(So|so)(\.\d)+$", "object_file"),
]

GROUP_START, GROUP_END = "-Wl,--start-group", "-Wl,--end-group"

#: Why no intermediate code is made; of several reasons the last counts.
SKIP_REASONS = [
    ("configure_only", "we are in configure-only mode"),
    ("no_inputs", "the list of input files is empty"),
    ("emit_llvm", "the compiler will generate bitcode in emit-llvm mode"),
    ("lto", "the compiler will generate bitcode during the link-time optimization"),
    ("assembly", "the input file(s) are written in assembly"),
    ("assemble_only", "we are only assembling, so cannot embed the path of the bitcode"),
    ("dependency_only", "we are only computing dependencies"),
    ("preprocess_only", "we are only preprocessing"),
    ("print_only", "we are in print-only mode, so cannot embed the path of the bitcode"),
]

#: Section that holds embedded paths, by format.
ELF_SECTION, MACHO_SECTION = ".llvm_bc", "__llvm_bc"

#: Log levels by ordinal.
LOG_LEVELS = ["error", "warn", "info", "debug", "trace"]

#: Names in a table of options, what they set here, and their types.
OPTION_KEYS = {
    "clang_filepath": ("compiler.Clang", str),
    "clangxx_filepath": ("compiler.ClangXX", str),
    "llvm_ar_filepath": ("archiver", str),
    "llvm_link_filepath": ("linker", str),
    "bitcode_store_path": ("store", str),
    "llvm_link_flags": ("merge_flags", list),
    "lto_ldflags": ("lto_flags", list),
    "bitcode_generation_flags": ("bitcode_flags", list),
    "is_configure_only": ("configure_only", bool),
    "log_level": ("log_level", int),
}
#: Names of tools that no plan here has a use for.
UNUSED_KEYS = {"llvm_config_filepath", "llvm_objcopy_filepath"}

#: Tool versions that are looked for, from the highest down.
TOOL_VERSIONS = (33, 6)

#: The tool that knows where the others are, and the option that names it in the
#: environment.
CONFIG_TOOL, CONFIG_VARIABLE = "llvm-config", "LLVM_CONFIG"

#: Tools that a build needs beside it, and what they set in its options.
TOOL_NAMES = {"clang": "compiler.Clang", "clang++": "compiler.ClangXX", "llvm-ar": "archiver", "llvm-link": "linker", "llvm-objcopy": None}

# -----------------------------------------------------------------------------

EXACT_RULES = {flag: (handler, arity) for handler, arity, flags in EXACT for flag in flags.split()}


def java_pattern(pattern: str) -> str:
    """The pattern for Spark's regex engine: only \\n ends a line, digits are
    Unicode's, and $ means the very end."""
    return "(?dU)" + (pattern[:-1] + r"\z" if pattern.endswith("$") else pattern)


def literal_start(pattern: str) -> str:
    """What every match of a pattern that begins with ^ begins with."""
    return re.match(r"\^((?:[A-Za-z0-9=,-](?![?*+{]))*)", pattern).group(1)


def rule_of(token: Column) -> Column:
    """struct(handler, arity) of a token; handler `group` at a linker group's
    start, null where no rule matches.

    A pattern costs much more than a look at how the token begins, and a map is
    searched from its start: so exact rules are found by length first, and patterns
    are tried only on tokens that begin as they do."""

    def rule(handler: str | None, arity: int = 0) -> Column:
        return F.struct(F.lit(handler).cast("string").alias("handler"), F.lit(arity).alias("arity"))

    by_length: dict[int, dict[str, tuple]] = {}
    for flag, own in EXACT_RULES.items():
        by_length.setdefault(len(flag), {})[flag] = own
    maps = {n: F.create_map(*chain.from_iterable((F.lit(flag), rule(*r)) for flag, r in own.items())) for n, own in by_length.items()}
    exact = F.create_map(*chain.from_iterable((F.lit(n), own) for n, own in sorted(maps.items())))
    flags, others = F.when(token == GROUP_START, rule("group")), F
    for pattern, handler in PATTERNS:
        start, found = literal_start(pattern), token.rlike(java_pattern(pattern))
        flags = flags.when(F.startswith(token, F.lit(start)) & found if start else found, rule(handler))
        if not start:
            others = others.when(found, rule(handler))
    by_pattern = F.when(F.startswith(token, F.lit("-")), flags.otherwise(rule(None))).otherwise(others.otherwise(rule(None)))
    return F.coalesce(F.try_element_at(F.try_element_at(exact, F.length(token)), token), by_pattern)
