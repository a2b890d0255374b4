"""Bundled line-pattern rules, as data for the pattern operators."""

# ruff: noqa: E501
# Rule ids, severities and patterns that results depend on, in the order of their ids.
# (id, kind, severity, required, paths, {language: patterns}); "all" holds for every language.
PATTERN_RULES: list[tuple[str, str, str, bool, list[str], dict[str, list[str]]]] = [
    ("c-array-safety", "source-pattern", "error", True, [], {"c": [r'\b(?:char|short|int|long|float|double|size_t)\s+[A-Za-z_]\w*\s*\[\s*[A-Za-z_]\w*\s*\]'], "cpp": [r'\b(?:char|short|int|long|float|double|size_t)\s+[A-Za-z_]\w*\s*\[\s*[A-Za-z_]\w*\s*\]']}),
    ("c-assertion-discipline", "source-pattern", "warning", True, [], {"c": [r'\bassert\s*\([^)]*(?:\+\+|--)'], "cpp": [r'\bassert\s*\([^)]*(?:\+\+|--)']}),
    ("c-control-flow", "source-pattern", "warning", True, [], {"c": [r'\bfor\s*\(\s*;', r'\bfor\s*\(\s*(?:float|double)\b'], "cpp": [r'\bfor\s*\(\s*;', r'\bfor\s*\(\s*(?:float|double)\b']}),
    ("c-expression-safety", "source-pattern", "warning", True, [], {"c": [r'\bsizeof\s*\([^)]*(?:\+\+|--)'], "cpp": [r'\bsizeof\s*\([^)]*(?:\+\+|--)']}),
    ("c-file-security", "source-pattern", "error", True, [], {"c": [r'\b(?:mktemp|tmpnam)\s*\('], "cpp": [r'\b(?:mktemp|tmpnam)\s*\(']}),
    ("c-function-safety", "source-pattern", "warning", True, [], {"c": [r'\b(?:abort|exit|realloc|alloca|pthread_exit|ExitThread)\s*\('], "cpp": [r'\b(?:abort|exit|realloc|alloca|pthread_exit|ExitThread)\s*\(']}),
    ("c-ignored-atomic-cas", "source-pattern", "warning", False, [], {"c": [r'\(\s*void\s*\)\s*atomic_compare_exchange_(?:weak|strong)(?:_explicit)?\s*\('], "cpp": [r'\(\s*void\s*\)\s*atomic_compare_exchange_(?:weak|strong)(?:_explicit)?\s*\(']}),
    ("c-numeric-literal", "source-pattern", "error", True, [], {"c": [r'\b(?:0[xX][0-9A-Fa-f]+|[0-9]+)(?:[uU]?l{1,2}|l{1,2}[uU]?)\b'], "cpp": [r'\b(?:0[xX][0-9A-Fa-f]+|[0-9]+)(?:[uU]?l{1,2}|l{1,2}[uU]?)\b']}),
    ("cpp-catch-by-reference", "source-pattern", "warning", True, [], {"cpp": [r'\bcatch\s*\(\s*(?:const\s+)?(?:std::)?(?:[A-Z][A-Za-z_]\w*|exception|runtime_error|logic_error)\s+[A-Za-z_]\w*\s*\)']}),
    ("cpp-disabled-test", "source-pattern", "warning", False, [], {"cpp": [r'\bDISABLED_[A-Za-z0-9_]*\b']}),
    ("cpp-no-alloca", "source-pattern", "warning", True, [], {"cpp": [r'\balloca\s*\(']}),
    ("cpp-no-direct-mutex", "source-pattern", "warning", True, [], {"cpp": [r'\b[A-Za-z_]\w*\.(?:lock|unlock)\s*\(']}),
    ("cpp-no-realloc", "source-pattern", "warning", True, [], {"cpp": [r'\b(?:std::)?realloc\s*\(']}),
    ("cpp-no-std-move-local-return", "source-pattern", "warning", True, [], {"cpp": [r'\breturn\s+std::move\s*\(']}),
    ("cpp-no-throw-spec", "source-pattern", "warning", True, [], {"cpp": [r'\b[A-Za-z_]\w*\s+[A-Za-z_]\w*\s*\([^)]*\)\s*throw\s*\(\s*\)']}),
    ("cpp-no-unsafe-memfunc", "source-pattern", "error", True, [], {"cpp": [r'\b(?:strcpy|strcat|sprintf|gets)\s*\(']}),
    ("cpp-no-unsafe-rand", "source-pattern", "warning", True, [], {"cpp": [r'\brand\s*\(']}),
    ("cpp-throw-by-value", "source-pattern", "warning", True, [], {"cpp": [r'\bthrow\s+new\s+']}),
    ("go-cgo-cstring-without-defer-free", "source-pattern", "warning", True, [], {"go": [r'\bC\.(?:CString|CBytes)\s*\(']}),
    ("go-dot-import", "source-pattern", "warning", True, [], {"go": [r'^\s*(?:import\s+)?\.\s+"']}),
    ("go-file-permission-creation", "source-pattern", "warning", True, [], {"go": [r'\b(?:os\.OpenFile|os\.WriteFile|ioutil\.WriteFile)\s*\([^)]*\b0o?(?:666|777)\b']}),
    ("go-float-loop-counter", "source-pattern", "warning", True, [], {"go": [r'\bfor\s+[A-Za-z_]\w*\s*(?::=|=)\s*\d+\.\d+']}),
    ("go-insecure-randomness", "source-pattern", "warning", True, [], {"go": [r'\bmath/rand\b|\brand\.(?:Intn|Int|Float64|Read)\s*\(']}),
    ("go-panic-in-exported-function", "source-pattern", "warning", True, [], {"go": [r'\bpanic\s*\(']}),
    ("go-relative-import-path", "source-pattern", "warning", True, [], {"go": [r'^\s*(?:import\s+)?\"\.\.?/']}),
    ("go-sensitive-info-in-log", "source-pattern", "warning", True, [], {"go": [r'(?i)\b(?:log|fmt)\.(?:Print|Fprint|Sprint|Fatal|Panic)\w*\s*\([^)]*\b(?:password|passwd|secret|token|key|credential)\b']}),
    ("go-sql-injection", "source-pattern", "error", True, [], {"go": [r'(?i)\bfmt\.Sprintf\s*\([^)]*\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\b', r'(?i)["\x60][^"\x60]*\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\b[^"\x60]*["\x60]\s*\+\s*[A-Za-z_]\w*']}),
    ("go-ssh-insecure-ignore-host-key", "source-pattern", "error", True, [], {"go": [r'\b(?:ssh\.)?InsecureIgnoreHostKey\s*\(']}),
    ("go-tls-insecure-skip-verify", "source-pattern", "error", True, [], {"go": [r'\bInsecureSkipVerify\s*:\s*true\b']}),
    ("java-empty-catch", "source-pattern", "warning", True, [], {"java": [r'\bcatch\s*\([^)]*\)\s*\{\s*\}']}),
    ("java-finalizer", "source-pattern", "warning", True, [], {"java": [r'\b(?:protected\s+|public\s+)?void\s+finalize\s*\(']}),
    ("java-finally-exit", "source-pattern", "error", True, [], {"java": [r'\bfinally\s*\{[^}]*(?:return|break|continue|throw)\b']}),
    ("java-implicit-charset", "source-pattern", "warning", True, [], {"java": [r'\bgetBytes\s*\(\s*\)']}),
    ("java-implicit-locale", "source-pattern", "warning", True, [], {"java": [r'\b(?:toLowerCase|toUpperCase)\s*\(\s*\)']}),
    ("java-insecure-random", "source-pattern", "warning", True, [], {"java": [r'\bnew\s+Random\s*\(']}),
    ("java-manual-gc", "source-pattern", "error", True, [], {"java": [r'\b(?:System\.gc|Runtime\.getRuntime\(\)\.gc)\s*\(']}),
    ("java-runtime-exec", "source-pattern", "warning", True, [], {"java": [r'\bRuntime\.getRuntime\(\)\.exec\s*\(']}),
    ("java-sql-concat", "source-pattern", "warning", True, [], {"java": [r'\b(?:executeQuery|executeUpdate|prepareStatement)\s*\([^)]*\+']}),
    ("java-thread-stop", "source-pattern", "error", True, [], {"java": [r'\b[Tt]hread[A-Za-z0-9_]*\.stop\s*\(']}),
    ("java-thread-yield", "source-pattern", "warning", True, [], {"java": [r'\bThread\.yield\s*\(']}),
    ("java-weak-crypto", "source-pattern", "error", True, [], {"java": [r'\b(?:MessageDigest|Cipher)\.getInstance\s*\(\s*"(?:MD5|SHA-?1|DES|RC4)"']}),
    ("no-bare-except", "file-pattern", "error", True, [], {"python": [r'^\s*except\s*:']}),
    ("no-emoji", "file-pattern", "error", True, [], {"all": [r'[\x{1F300}-\x{1F9FF}]|[\x{2600}-\x{27BF}]|[\x{1F000}-\x{1F02F}]|[\x{1F0A0}-\x{1F0FF}]|[\x{1F100}-\x{1F1FF}]|[\x{1F200}-\x{1F2FF}]|[\x{1FA00}-\x{1FA6F}]|[\x{1FA70}-\x{1FAFF}]']}),
    ("no-os-path", "file-pattern", "error", True, [], {"python": [r'\bos\.path\.(?:join|exists|isfile|isdir|dirname|basename|abspath|normpath|splitext|split|splitdrive|relpath|realpath|expanduser|expandvars|samefile|getsize|getatime|getmtime|getctime)\s*\(']}),
    ("no-print", "file-pattern", "warning", True, [], {"python": [r'^\s*print\s*\(']}),
    ("no-printf-log", "file-pattern", "error", True, [], {"c": [r'\b(?:printf|fprintf)\s*\('], "cpp": [r'\b(?:printf|fprintf)\s*\(']}),
    ("no-test-sleep", "file-pattern", "error", True, ['**/test/**', '**/tests/**', '**/*_test.*', '**/*_test_*.*', '**/*Test.*'], {"all": [r'(?i)\b(?:sleep|usleep|nanosleep)\s*\(']}),
    ("no-unsafe-string", "file-pattern", "error", True, [], {"c": [r'\b(?:strcpy|sprintf|strcat|gets)\s*\('], "cpp": [r'\b(?:strcpy|sprintf|strcat|gets)\s*\(']}),
    ("py-assert-in-production", "source-pattern", "warning", True, [], {"python": [r'^\s*assert\s+']}),
    ("py-bare-except", "source-pattern", "warning", True, [], {"python": [r'^\s*except\s*:']}),
    ("py-eval-exec", "source-pattern", "error", True, [], {"python": [r'\b(?:eval|exec)\s*\(']}),
    ("py-insecure-randomness", "source-pattern", "warning", True, [], {"python": [r'\brandom\.(?:random|randint|choice|shuffle|sample)\s*\(']}),
    ("py-mutable-default-argument", "source-pattern", "warning", True, [], {"python": [r'\bdef\s+\w+\s*\([^)]*=\s*(?:\[\]|\{\}|set\(\))']}),
    ("py-pickle-load", "source-pattern", "error", True, [], {"python": [r'\b(?:pickle|cPickle|shelve|marshal)\.(?:load|loads)\s*\(']}),
    ("py-sensitive-info-in-log", "source-pattern", "warning", True, [], {"python": [r'(?i)\b(?:logging|log|logger)\.(?:debug|info|warning|error|critical)\s*\([^)]*(?:password|passwd|secret|token|key|credential)']}),
    ("py-shell-equals-true", "source-pattern", "error", True, [], {"python": [r'\bsubprocess\.\w+\s*\([^)]*\bshell\s*=\s*True\b']}),
    ("py-tempfile-mktemp", "source-pattern", "error", True, [], {"python": [r'\btempfile\.mktemp\s*\(']}),
    ("py-tls-verify-disabled", "source-pattern", "error", True, [], {"python": [r'\bverify\s*=\s*False\b']}),
    ("py-yaml-unsafe-load", "source-pattern", "error", True, [], {"python": [r'\byaml\.load\s*\(']}),
    ("rust-extern-without-abi", "source-pattern", "warning", True, [], {"rust": [r'^\s*(?:unsafe\s+)?extern\s*\{']}),
    ("rust-unsafe-block-in-macro-definition", "source-pattern", "warning", True, [], {"rust": [r'\bmacro_rules!\s*[A-Za-z_][A-Za-z_0-9]*.*\bunsafe\s*\{']}),
    ("rust-untrusted-dynamic-library-loading", "source-pattern", "error", True, [], {"rust": [r'\b(?:dlopen|(?:libloading::)?Library::(?:new|load))\s*\(\s*(?:&\s*)?[A-Za-z_][A-Za-z_0-9]*']}),
    ("security-sensitive-api", "source-pattern", "warning", True, [], {"java": [r'\b(?:Runtime\.getRuntime\(\)\.exec|ProcessBuilder)\b'], "python": [r'\b(?:eval|exec)\s*\(', r'\bpickle\.loads\s*\('], "rust": [r'\bunsafe\s*\{'], "typescript": [r'\b(?:eval|Function)\s*\(', r'\b(?:exec|execSync)\s*\('], "go": [r'\bexec\.Command(?:Context)?\s*\(']}),
    ("shell-debug-mode", "source-pattern", "warning", True, [], {"shell": [r'\b(?:set\s+-[A-Za-z]*[xv]\b|bash\s+-[A-Za-z]*[xv]\b)']}),
    ("shell-env-dump", "source-pattern", "warning", True, [], {"shell": [r'(?:^|[;&|])\s*(?:set|env|declare|typeset|export)\s*(?:\||>{1,2})']}),
    ("shell-exec-terminates", "source-pattern", "warning", True, [], {"shell": [r'^\s*exec\s+\S']}),
    ("shell-line-start-operator", "source-pattern", "warning", True, [], {"shell": [r'^\s*(?:\|\|?|\&\&)\s+']}),
    ("shell-password-echo", "source-pattern", "warning", True, [], {"shell": [r'(?i)\bread\s+(?:-r\s+)?(?:[A-Za-z_][A-Za-z0-9_]*_)?password\b']}),
    ("shell-sql-injection", "source-pattern", "error", True, [], {"shell": [r'(?i)\b(?:mysql|psql|sqlite3|sqlplus)\b[^\n]*\$(?:\{)?(?:1|[A-Za-z_][A-Za-z0-9_]*)']}),
    ("shell-stream-merge-position", "source-pattern", "warning", True, [], {"shell": [r'(?:2>&1\s+>|1>&2\s+2>)']}),
    ("shell-temp-file-hardcoded", "source-pattern", "warning", True, [], {"shell": [r'(?i)/tmp/[a-z]']}),
    ("shell-tilde-path", "source-pattern", "warning", True, [], {"shell": [r'(?:^|[^A-Za-z0-9_])~(?:/|$)']}),
    ("shell-trap-double-quotes", "source-pattern", "warning", True, [], {"shell": [r'(?i)\btrap\b\s+"']}),
    ("shell-trap-numeric-signal", "source-pattern", "warning", True, [], {"shell": [r'(?i)\btrap\b.*\b(?:[1-9]|[12][0-9])\b']}),
    ("shell-weak-crypto", "source-pattern", "warning", True, [], {"shell": [r'(?i)\b(?:des|rc4|md5|sha1)\b']}),
    ("todo-marker", "source-pattern", "warning", True, [], {"all": [r'(?i)\b(?:TODO|FIXME|XXX)\b']}),
    ("ts-eqeqeq", "source-pattern", "warning", True, [], {"typescript": [r'(?:[^=!<>]==[^=]|[^!]!=[^=])']}),
    ("ts-no-alert", "source-pattern", "warning", True, [], {"typescript": [r'\b(?:alert|confirm|prompt)\s*\(']}),
    ("ts-no-commented-code", "source-pattern", "warning", True, [], {"typescript": [r'^\s*//\s*(?:const|let|var|function|return|if|for|while|switch|class|import|export)\b']}),
    ("ts-no-debugger", "source-pattern", "error", True, [], {"typescript": [r'^\s*debugger\s*;?\s*$']}),
    ("ts-no-eval", "source-pattern", "error", True, [], {"typescript": [r'\beval\s*\(']}),
    ("ts-no-extend-native", "source-pattern", "error", True, [], {"typescript": [r'\b(?:Object|Array|String|Number|Boolean|Function|Date|RegExp|Error)\.prototype(?:\.[A-Za-z_$][\w$]*)?\s*=[^=]']}),
    ("ts-no-implied-eval", "source-pattern", "error", True, [], {"typescript": [r'\b(?:setTimeout|setInterval)\s*\(\s*["\x27]']}),
    ("ts-no-new-function", "source-pattern", "error", True, [], {"typescript": [r'\bnew\s+Function\s*\(']}),
    ("ts-no-personal-info-in-comments", "source-pattern", "warning", True, [], {"typescript": [r'(?i)(?://|/\*|\*)[^\n]*(?:@author|email\s*[:=]|phone\s*[:=]|\b[\w.+-]+@[\w.-]+\.[a-z]{2,})']}),
    ("ts-no-prototype-builtins", "source-pattern", "warning", True, [], {"typescript": [r'\.\s*(?:hasOwnProperty|isPrototypeOf|propertyIsEnumerable)\s*\(']}),
    ("ts-no-unsafe-postmessage", "source-pattern", "warning", True, [], {"typescript": [r'\bpostMessage\s*\(']}),
    ("ts-secure-randomness", "source-pattern", "warning", True, [], {"typescript": [r'\bMath\.random\s*\(']}),
    ("workaround-marker", "source-pattern", "warning", False, [], {"all": [r'(?i)\bworkaround\b|\btemporary\s+fix\b|暂时规避|临时方案|临时绕过']}),
]
