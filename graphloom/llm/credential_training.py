"""Labelled lines for the credential tagger, made from templates with random names and values.

No labelled data exist for credentials, so the tagger is trained on lines that
this module writes: settings, code, comments, addresses and commands, each with
a usable credential (between the marks « and ») or with something that only looks
like one. The vocabulary is random; nothing is taken from the tables.
"""

from __future__ import annotations

import random
import string

_SYLLABLES = [a + b for a in "bdfgklmnprstvz" for b in "aeiou"]
_ALNUM = string.ascii_letters + string.digits
_SECRET_NAMES = (
    "password passwd pwd pass passphrase secret client_secret token access_token auth_token bot_token refresh_token api_key "
    "apikey access_key private_key signing_key secret_key master_pw smtp_pass db_password credential hmac_secret kennwort "
    "clave_api ldap_bind_pw encryption_key passwort"
).split()
_SPOKEN_NAMES = "password passwd pwd db_password passphrase kennwort smtp_pass master_pw passcode login_pin secret passwort".split()
_ABOUT_NAMES = (
    "password_min_length token_limit token_type password_field secret_rotation_days password_hint api_key_file "
    "token_count password_policy secret_file token_budget refresh_token_file auth_token_ttl credential_type"
).split()
_DIGEST_NAMES = "commit_sha build_sha artifact_sha256 checksum file_hash digest integrity etag md5sum".split()
_ID_NAMES = "run_id trace_id request_id build_id session_uuid".split()


class Writer:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def word(self, low: int = 2, high: int = 4) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(low, high)))

    def name(self) -> str:
        return self.r.choice("_.-").join(self.word() for _ in range(self.r.randint(1, 2)))

    def styled(self, name: str) -> str:
        words = name.split("_")
        style = self.r.randrange(5)
        if style == 0:
            return "_".join(words).upper()
        if style == 1:
            return words[0] + "".join(w.title() for w in words[1:])
        if style == 2:
            return ".".join(words)
        if style == 3:
            return "-".join(words)
        return "_".join(words) + (f"_{self.r.randrange(30)}" if self.r.random() < 0.3 else "")

    def run(self, n: int, alphabet: str = _ALNUM) -> str:
        return "".join(self.r.choice(alphabet) for _ in range(n))

    def letters(self) -> str:
        """Mostly letters and digits, now and then letters only."""
        return string.ascii_letters if self.r.random() < 0.25 else _ALNUM

    def typed(self) -> str:
        kind = self.r.randrange(4)
        if kind == 0:
            return "AKIA" + self.run(16, string.ascii_uppercase + string.digits)
        if kind == 1:
            return f"eyJ{self.run(30)}.eyJ{self.run(60)}.{self.run(40, _ALNUM + '-_')}"
        head = self.r.choice(["sk_live_", "ghp_", "npm_", "pk3_", "tok_", "gho_", "rk_test_", "abc_"])
        return head + self.run(36)

    def digest(self) -> str:
        return self.run(self.r.choice([32, 40, 48, 64]), "0123456789abcdef")

    def loose(self) -> str:
        """A credential that only its place gives away."""
        kind = self.r.randrange(6)
        if kind == 0:
            return self.digest()
        if kind == 1:
            return self.run(40, _ALNUM + "+/")
        if kind == 2:
            return self.word(2, 4).title() + self.r.choice("!@#$%_-*") + str(self.r.randrange(10, 3000)) + self.r.choice(["", "!", "x", "Q"])
        if kind == 3:
            return self.r.choice(string.ascii_letters) + self.run(self.r.randint(9, 22), _ALNUM + "!@#$%&*_-") + str(self.r.randrange(10))
        if kind == 4:
            return self.run(self.r.randint(10, 18), _ALNUM) + str(self.r.randrange(10)) + self.run(2, string.ascii_letters)
        return self.run(36, _ALNUM + ".-_")

    def spoken(self) -> str:
        """A credential of plain words or digits, which only its name gives away."""
        kind = self.r.randrange(5)
        if kind == 0:
            return str(self.r.randrange(1000, 99_999_999))
        if kind == 1:
            return self.r.choice("-_.").join(self.word() for _ in range(self.r.randint(2, 4)))
        return self.word(3, 5).title() if kind == 2 else self.word(3, 5)

    def any(self) -> str:
        return self.typed() if self.r.random() < 0.5 else self.loose()

    def placeholder(self) -> str:
        r = self.r
        return r.choice(
            ["changeme", "not-set", "your-password", "dummy", "REPLACE_ME", "<token>", "<your-key-here>", "xxxxxxxx", "********",
             "${%s}" % self.word().upper(), "{{ %s }}" % self.word(), "example", "todo", "%%%s%%" % self.word().upper(), "none",
             "your-" + self.word(), "null", "placeholder", "&lt;token&gt;"]
        )

    def plain(self) -> str:
        r = self.r
        return r.choice([self.word(), f"{self.word()} {self.word()}", str(r.randrange(9999)), "true", "false", self.name(), "/run/" + self.word(),
                         f"{self.word()}.{self.word()}", "null", str(r.random())[:5]])

    def host(self) -> str:
        return f"{self.word()}.{self.word()}.example"

    def pair(self, name: str, value: str) -> tuple[str, str]:
        """(extension, line) of a setting."""
        k = self.styled(name)
        q = self.r.choice(['"', '"', "'"])
        forms = [
            ("env", f'{k.upper().replace(".", "_").replace("-", "_")}="{value}"'),
            ("env", f"{k}={value}"),
            ("properties", f"{k}={value}"),
            ("properties", f'{k} = "{value}"'),
            ("yml", f"{k}: {value}"),
            ("yml", f'  {k}: "{value}"'),
            ("json", f'    "{k}": "{value}",'),
            ("xml", f'  <property name="{k}" value="{value}"/>'),
            ("xml", f"  <{k}>{value}</{k}>"),
            ("py", f"{k.replace('.', '_').replace('-', '_')} = {q}{value}{q}"),
            ("java", f'    private static final String {k.replace(".", "_").replace("-", "_")} = "{value}";'),
            ("js", f'var {k.replace(".", "_").replace("-", "_")} = "{value}";'),
            ("py", f'{self.word()}({k.replace(".", "_").replace("-", "_")}="{value}")'),
            ("js", f"var {self.word()}Opts = {{ user: '{self.word()}', {name}: '{value}' }};"),
            ("py", f'{self.word()}_opts = {{"user": "{self.word()}", "{name}": "{value}"}}'),
            ("java", f'connect("user={self.word()};{name}={value};")'),
        ]
        return self.r.choice(forms)

    def line(self) -> tuple[str, str]:
        r = self.r
        kind = r.randrange(24)
        code = r.choice(["py", "java", "js"])
        mark = "#" if code == "py" else "//"
        if kind <= 2:
            return self.pair(r.choice(_SECRET_NAMES), f"«{self.any()}»")
        if kind == 3:
            return self.pair(self.name().replace("-", "_").replace(".", "_"), f"«{self.typed()}»")
        if kind == 4:
            return self.pair(r.choice(_SECRET_NAMES), self.placeholder())
        if kind == 5:
            return self.pair(r.choice(_ABOUT_NAMES), self.plain())
        if kind == 6:
            return self.pair(r.choice(_DIGEST_NAMES), r.choice([self.digest(), "sha512-" + self.run(80, _ALNUM + "+/"), "sha256:" + self.digest()]))
        if kind == 7:
            u = self.run(32, "0123456789abcdef")
            return self.pair(r.choice(_ID_NAMES), f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}")
        if kind == 8:
            return self.pair(self.name().replace("-", "_").replace(".", "_"), self.plain())
        if kind in (9, 10):
            secret = r.choice([self.run(r.randint(8, 18), self.letters()) + r.choice(["", str(r.randrange(10))]), self.loose().replace("/", "").replace("@", "").replace("#", "")])
            scheme = r.choice(["https", "postgres", "mysql", "amqp", "mongodb", "redis"])
            url = f"{scheme}://{self.word()}:«{secret}»@{self.host()}:{r.randrange(1000, 9999)}/{self.word()}"
            return self.pair(r.choice(["dsn", "jdbc", "uri", "upstream", "remote", self.word() + "_dsn"]), url)
        if kind == 11:
            url = f"https://{self.word()}:{r.choice(['${PASS}', '<password>', '****', 'changeme', '${%s}' % self.word().upper()])}@{self.host()}/{self.word()}"
            return self.pair(r.choice(["dsn", "uri", "upstream"]), url)
        if kind == 12:
            name = r.choice(["sig", "access", "token", "key", "secret", "auth", "signature", "api_key"])
            url = f"https://{self.host()}/{self.word()}?{name}=«{self.run(r.choice([24, 32, 40]), self.letters())}»{r.choice(['', '&v=3', '&page=2'])}"
            return self.pair(r.choice(["callback", "hook", self.word() + "_url"]), url)
        if kind == 13:
            url = f"https://{self.host()}/{self.word()}?{r.choice(['page', 'v', 'id', 'lang', 'q'])}={r.choice([str(r.randrange(99)), self.word()])}"
            return self.pair(r.choice(["callback", "hook", self.word() + "_url", "endpoint"]), url)
        if kind == 14:
            value = f"{r.choice(['Bearer', 'Basic', 'Authorization: Token', 'Authorization: Bearer', 'Token'])} «{self.run(40, _ALNUM + '-._')}»"
            while True:
                ext, line = self.pair(r.choice(["default_header", "header", "upstream_auth", "authorization"]), value)
                if "connect(" not in line:
                    return ext, line
        if kind == 15:
            return code, f"{mark} curl -u {self.word()}:«{self.run(r.randint(9, 18), self.letters()) + r.choice(['', str(r.randrange(10))])}» https://{self.host()}/{self.word()}"
        if kind == 16:
            name = self.styled(r.choice(_SECRET_NAMES) if r.random() < 0.7 else self.word() + "_" + self.word())
            value = self.any() if key_is_secret(name) else self.typed()
            return code, mark + r.choice([f" old {name} was «{value}»", f" {name}: «{value}» (rotate)", f" login with {name} «{value}»", f" {name} = «{value}»"])
        if kind == 17:
            return code, mark + r.choice(
                [f" the password must have {r.randrange(99)} letters", f" secret rotation runs every {r.randrange(99)} days",
                 f" token budget is {r.randrange(99)} per {self.word()}", f" {self.word()} the {self.word()} token before the {self.word()}",
                 f" see commit {self.digest()[:40]}", f" build {self.digest()[:32]} was {self.word()}", f" {self.word()} {self.name()} {self.word()}"]
            )
        name = r.choice(_SECRET_NAMES)
        if kind == 18:
            env = self.word().upper() + r.choice(["_KEY", "_TOKEN", ""])
            value = f"«{self.any()}»"
            neutral = r.choice([name, self.word() + "_" + self.word()])
            return r.choice(
                [("py", f'{neutral} = os.environ.get("{env}", "{value}")'), ("java", f'String {neutral} = System.getProperty("{env}", "{value}");'),
                 ("js", f'var {neutral} = process.env.{env} || "{value}";'), ("py", f'{neutral} = os.getenv("{env}", "{value}")')]
            )
        if kind == 19:
            if r.random() < 0.3:
                name = r.choice(_SPOKEN_NAMES)
            return r.choice(
                [("py", f'{name} = os.environ["{name.upper()}"]'), ("js", f'var {name} = process.env["{name.upper()}"];'), ("py", f'{name} = config.get("{name}")'),
                 ("java", f'String {name} = System.getenv("{name.upper()}");'), ("py", f'{name} = os.environ.get("{name.upper()}", "{self.placeholder()}")')]
            )
        if kind == 20:
            f = self.word()
            names = ", ".join(f"'{self.word()}_{self.word()}_{r.randrange(99)}'" for _ in range(r.randint(2, 6)))
            return r.choice(
                [("py", f"    __slots__ = ({names})"), ("js", f"var {f} = [{names}];"), ("java", f"    /** {{@{f}Doc}} {self.word()} */"),
                 ("json", f'    "{self.name()}_{r.randrange(99)}": "{self.word()}_{r.randrange(99)}",')]
            ) if r.random() < 0.3 else r.choice(
                [("py", f'{f}.{self.word()}({self.word()}, "{self.word()} {self.word()}", {r.randrange(9999)})'), ("js", f'this.{f}.{self.word()}("{self.word()}.{self.word()}");'),
                 ("java", f'var {f} = this.{self.word()}.copyTokenKey({self.word()}, "{self.word()}");'), ("py", f"def get_token_{f}(self, {self.word()}: int) -> str:")]
            )
        if kind == 22:
            return self.pair(r.choice(_SPOKEN_NAMES), f"«{self.spoken()}»")
        if kind == 21:
            blob = self.run(76, _ALNUM + "+/")
            return code, f'    "{blob}",'
        return self.pair(self.name().replace("-", "_").replace(".", "_"), f"{self.word()}-{r.randrange(999)}" if r.random() < 0.3 else self.placeholder())


def key_is_secret(name: str) -> bool:
    from graphloom.llm.credential_tokens import key_class

    return key_class(name) == "secret"


def labelled(n: int, seed: int) -> list[tuple[str, str, list[tuple[int, int]]]]:
    """(extension, line, spans of credentials) of ``n`` lines."""
    writer = Writer(seed)
    out = []
    for _ in range(n):
        ext, marked = writer.line()
        spans, line = [], ""
        for piece in marked.replace("»", "«").split("«"):
            spans.append((len(line), len(line) + len(piece)))
            line += piece
        out.append((ext, line, spans[1::2]))
    return out
