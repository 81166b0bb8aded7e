"""A second family of secrets and look-alikes, written apart from the generator that the model learns from.

Values are set into texts of the documents table at random places, in the notation of the file type they'd be found in. Real secrets
are drawn from other shapes and settings than the generator's; look-alikes are common identifiers of documents.
"""

import base64
import random
import string

UP, LOW, DIG = string.ascii_uppercase, string.ascii_lowercase, string.digits
ALNUM = UP + LOW + DIG
HEX = "0123456789abcdef"


def families(rnd):
    s = lambda chars, n: "".join(rnd.choice(chars) for _ in range(n))
    b64 = lambda n: base64.b64encode(bytes(rnd.randrange(256) for _ in range(n))).decode()
    name = lambda: rnd.choice("billing mailer worker staging ingest archive ledger gateway backup report".split())
    secrets = {
        "aws secret": lambda: ("aws_secret_access_key=", s(ALNUM + "+/", 40), "\n"),
        "azure account": lambda: (f"AccountName={name()};AccountKey=", b64(64), ";EndpointSuffix=core"),
        "jwt": lambda: ("Cookie: session=", f"eyJ{s(ALNUM, 33)}.eyJ{s(ALNUM, 60)}.{s(ALNUM + '-_', 43)}", "; Path=/"),
        "sendgrid": lambda: ("MAIL_KEY ", f"SG.{s(ALNUM + '-_', 22)}.{s(ALNUM + '-_', 43)}", " # mail"),
        "npm": lambda: ("//registry/:_authToken=", "npm_" + s(ALNUM, 36), "\n"),
        "github": lambda: ("git clone with ", "ghp_" + s(ALNUM, 36), " as user"),
        "gitlab": lambda: ("PRIVATE-TOKEN: ", "glpat-" + s(ALNUM + "-_", 20), "\n"),
        "slack": lambda: ("bot uses ", f"xoxb-{s(DIG, 12)}-{s(DIG, 12)}-{s(ALNUM, 24)}", " to post"),
        "stripe": lambda: ("charge(", "sk_live_" + s(ALNUM, 24), ")"),
        "google": lambda: ("maps?key=", "AIza" + s(ALNUM + "-_", 35), "&sensor=false"),
        "basic": lambda: ("Authorization: Basic ", b64(27), "\r\n"),
        "bearer": lambda: ("curl -H 'Authorization: Bearer ", s(ALNUM, 43), "' https"),
        "url password": lambda: (f"postgres://{name()}:", s(ALNUM, 16), f"@db.{name()}.internal:5432/main"),
        "yaml": lambda: ("client_secret:\n  ", s(ALNUM + "-_~", 36), "\n"),
        "pwd": lambda: ("login admin, pwd = ", s(ALNUM + "!#%", 12), " until friday"),
        "passphrase": lambda: ("passphrase: ", "".join(rnd.choice("copper window tunnel marble violin rocket".split()).capitalize() for _ in range(3)), "\n"),
        "pem": lambda: ("-----BEGIN KEY-----\n", "\n".join([s(ALNUM + "+/", 64) for _ in range(3)] + [s(ALNUM + "+/", 22) + "=="]), "\n-----END"),
        "upper hex": lambda: ("license key ", s(HEX.upper(), 40), " "),
    }
    others = {
        "uuid": lambda: ("request ", "-".join(s(HEX, n) for n in (8, 4, 4, 4, 12)), " failed"),
        "isbn": lambda: ("ISBN ", f"978-{s(DIG, 1)}-{s(DIG, 5)}-{s(DIG, 3)}-{s(DIG, 1)}", "."),
        "doi": lambda: ("see doi:", f"10.{s(DIG, 4)}/{s(LOW, 6)}.{s(DIG, 4)}.{s(DIG, 6)}", " for"),
        "url": lambda: ("read ", f"https://www.{s(LOW, 8)}.org/wiki/{s(LOW, 7)}_{s(LOW, 5)}/{s(DIG, 4)}", " there"),
        "path": lambda: ("open ", f"/home/{s(LOW, 5)}/projects/{s(LOW, 8)}/src/main.{s(LOW, 2)}", " and"),
        "mail": lambda: ("write to ", f"{s(LOW, 6)}.{s(LOW, 8)}@{s(LOW, 7)}.com", " today"),
        "phone": lambda: ("call ", f"+49 {s(DIG, 3)} {s(DIG, 8)}", " or"),
        "time": lambda: ("at ", f"2024-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}T{rnd.randint(10, 23)}:{s('012345', 1)}{s(DIG, 1)}:{s('012345', 1)}{s(DIG, 1)}Z", " it"),
        "camel": lambda: ("call ", "".join(rnd.choice("get set load user order index value cache".split()).capitalize() for _ in range(4)), " first"),
        "constant": lambda: ("set ", "_".join(rnd.choice("MAX SIZE LIMIT DEFAULT BUFFER COUNT".split()) for _ in range(3)), " to 5"),
        "version": lambda: ("needs ", f"lib{s(LOW, 5)}-{rnd.randint(1, 9)}.{rnd.randint(0, 20)}.{rnd.randint(0, 99)}.tar.gz", " or"),
        "iban": lambda: ("IBAN ", f"NL{s(DIG, 2)}ABNA{s(DIG, 10)}", ","),
        "order": lambda: ("order no. ", f"{s(UP, 2)}-{s(DIG, 8)}", " was sent"),
        "card": lambda: ("card ", " ".join(s(DIG, 4) for _ in range(4)), " expired"),
        "number": lambda: ("a total of ", s(DIG, 12), " units"),
        "mac": lambda: ("device ", ":".join(s(HEX, 2) for _ in range(6)), " joined"),
        "talk": lambda: ("never share your password with ", rnd.choice(["colleagues", "strangers", "everybody", "representatives"]), " at work"),
        "hyphens": lambda: ("a ", "-".join(rnd.choice("state of the art end to user face self service long term".split()) for _ in range(4)), " plan"),
        "hashtag": lambda: ("post #", s(LOW, 4) + s(UP, 1) + s(LOW, 6) + "2024", " now"),
        "longword": lambda: ("the ", s(LOW, 28), " of it"),
    }
    return secrets, others


def planted(texts, n, seed=77):
    """(text, [(start, end)] of secrets, [(start, end)] of look-alikes, kind) with one value each."""
    rnd = random.Random(seed)
    secrets, others = families(rnd)
    out = []
    for k in range(n):
        text = rnd.choice(texts)
        cut = text.find(" ", rnd.randrange(len(text))) + 1
        real = k % 2 == 0
        kind = rnd.choice(sorted(secrets if real else others))
        before, value, after = (secrets if real else others)[kind]()
        whole = text[:cut] + before + value + after + " " + text[cut:]
        at = cut + len(before)
        out.append((whole, (at, at + len(value)), real, kind))
    return out
