"""Template residue, filler and error pages (problem 8).

Texts are cut into segments (lines, sentences, and what menu signs part). A segment is normalised:
consistent form, lower case, no accents, white space collapsed, and numbers, addresses, dates and
codes masked. A segment gets its kind from the words it is made of:

* error, script: nothing but the words such messages are put in (CLOSED), with a sign of an error or
  a demand among them. No wording is listed, only words.
* filler: repeated keys, dummy Latin, or nothing but talk of text that is to come.
* furniture: menus, footers and polite formulas.

Equal normalised segments are grouped by an exact hash over all documents and sources. A segment
without a kind that a share of all texts and sources holds gets one by looser cues: words of demands
or errors in a short segment that tells nothing, or furniture if it has few words and is no
sentence. Dummy words are learned from the corpus: words that hardly ever stand in a segment
without known dummy Latin are dummy words too, and segments made of them are filler.

A text is residue if a slot meant to be filled was left open in it, outside quotation and code
marks, or if it holds error messages, demands or filler and nothing else but furniture. Null and
empty texts are not residue. Nothing has a limit of length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small, write_table
from .unify import has_beyond_ascii, unified

#: A segment of no known kind recurs if such a share of the texts and such a share of the sources hold it,
#: as furniture and, with the cues of a message, as one. Shares, so that the size of the input has no say.
FURNITURE_TEXTS, FURNITURE_SOURCES = 1 / 500, 1 / 3
MESSAGE_TEXTS, MESSAGE_SOURCES = 1 / 5000, 1 / 8
#: Whatever the shares, fewer texts or sources are no recurrence.
LEAST = 3

# Vietnamese letters by the plain letter they are built on.
PLAIN = {"a": "àáảãạăằắẳẵặâầấẩẫậ", "e": "èéẻẽẹêềếểễệ", "i": "ìíỉĩị", "o": "òóỏõọôồốổỗộơờớởỡợ", "u": "ùúủũụưừứửữự", "y": "ỳýỷỹỵ", "d": "đ"}

#: Names a slot may have: a variable, or words in brackets.
_NAME = r"[\p{L}_][\p{L}\p{N}_.\- ]*+"
#: Slots of the common template languages, and bracketed instructions.
SLOT = "|".join(
    [
        r"\{\{\{?\s*" + _NAME + r"(\|[^{}\n]*+)?\s*\}?\}\}",
        r"\$\{\s*" + _NAME + r"\s*\}",
        r"\{%-?\s*" + r"[\p{L}_][\p{L}\p{N}_. ]*+" + r"\s*-?%\}",
        r"<%[=-]?\s*" + r"[\p{L}_][\p{L}\p{N}_. ]*+" + r"\s*-?%>",
        r"\[\[\s*" + _NAME + r"\s*\]\]",
        r"<<\s*" + _NAME + r"\s*>>",
        r"@@\s*" + _NAME + r"\s*@@",
        r"##\s*" + _NAME + r"\s*##",
        r"__[A-Z][A-Z0-9]*+(_[A-Z0-9]++)*+__",
        r"%[A-Z][A-Z0-9]*+(_[A-Z0-9]++)*+%",
        r"(?<![\w$#])\{\s*[\p{L}_][\p{L}\p{N}_.]++( [\p{L}\p{N}_.]++){0,3}\s*\}",
        r"\[(?![0-9A-Fa-f]{6,}\])(?=[^\]\n]*\p{L}{2})[\p{L}][\p{L}\p{N} _/'-]{2,}+\]",
        r"<(?![/!])(?=[^>\n]*(\p{L}+ \p{L}+))[\p{L}][\p{L}\p{N} _'-]{2,}+>",
    ]
)
#: What stands in quotation or code marks is talked about, not left open.
QUOTED = r"```[^`]*+```|`[^`\n]*+`|\"[^\"\n]*+\"|“[^”\n]*+”|‘[^’\n]*+’|«[^»\n]*+»|(?<![\p{L}\p{N}])'[^'\n]*+'(?![\p{L}\p{N}])"

# What is typed to fill a field, and dummy Latin: the widely printed passages on pain and pleasure, and common generators.
MASH = "asdf asd qwer qwerty zxcv hjkl jkl fdsa uiop dfgh sdfg foo bar baz blah bla abc xyz test testing chu tet 123 1234 lorem".split()
PRESSED = "^(0|x{3,}|z{3,}|a{3,})$"
LATIN = """lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed eiusmod tempor incididunt labore dolore magna aliqua
 enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur
 excepteur sint occaecat cupidatat proident sunt culpa officia deserunt mollit anim laborum
 perspiciatis unde omnis iste natus voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae illo inventore veritatis quasi architecto beatae vitae dicta explicabo
 nonummy nibh euismod tincidunt laoreet aliquam erat volutpat wisi suscipit lobortis eum iriure hendrerit vulputate molestie illum feugiat facilisis eros accumsan iusto odio dignissim blandit praesent luptatum zzril delenit augue""".split()
LATIN_MORE = """pellentesque habitant morbi tristique senectus netus malesuada fames turpis egestas vestibulum tortor quam ultricies eget ante donec mauris placerat eleifend leo quisque vivamus integer cras curabitur aenean phasellus fusce nullam maecenas
 suspendisse pulvinar sagittis posuere cursus mattis lectus viverra purus faucibus ornare bibendum gravida rhoncus risus venenatis ligula sapien condimentum convallis dapibus dictum dictumst diam efficitur elementum fermentum finibus fringilla habitasse hac iaculis imperdiet interdum justo lacinia lacus libero luctus massa maximus metus mollis nunc orci platea potenti pretium proin sodales sollicitudin scelerisque tellus tempus ullamcorper urna varius vehicula vel semper porta rutrum magnis""".split()
# Words of dummy Latin that are words of other languages too, or too short to tell: filler only beside other filler.
LATIN_TOO = "a ab ac ad at cum do dui e est et eu ex hic id in ita mi nam nec non per qui sem si te tation ut".split()
#: Dummy words are learned in segments with at least so many known ones and such a share of them, and if so few of their segments hold none at all.
SEEDS, SEED_SHARE, STRAY = 2, 0.25, 0.15
#: A segment is filler if such a share of its words is known or learned dummy Latin.
DUMMY = 0.6

# Fixed values, plain words (accents dropped): what messages of programs to their users are put in. Words, not wordings.
GLUE = "the a an this that these those our your its it is are was were be been being has have had do does did not no can cannot could will won would may might must should need needs to of on in at for from by with and or but so if when while until unless before after as than any some too many more again later now right here there longer anymore yet still please sorry oops whoops we you re ve s t m doesn don isn wasn aren weren hasn haven hadn couldn wouldn shouldn go back try trying wait moment minute minutes seconds time first temporarily currently unfortunately".split()
THINGS = "page pages link resource document file files folder directory address url article post site website webpage service services server servers host gateway database system application app request requests session access connection login sign account content item path proxy network domain certificate token permission permissions browser object user username password credentials web internet upstream requested remote origin form view image video product method looking wanted tried asked open reach find view see refresh reload contact administrator support team help http https error err status code id ref reference ray case incident trace number zcode zhex zaddress specified log configuration misconfiguration unable port 0".split()
SIGNS = "found available unavailable moved removed deleted exist exists denied refused rejected blocked forbidden unauthorized unauthorised expired invalid valid errors failed failure fails timeout timed out overloaded busy down offline maintenance respond responding response answer bad wrong went something occurred happened encountered hit unexpected internal unknown crashed reset closed ended terminated aborted limit exceeded reached load loaded loading shown displayed opened connect connected establish establishing difficulties problem problems issue issues technical experiencing having exception fatal stopped ran working work works displaying returned took long allowed permitted authorized authorised accepted acceptable supported logged locked suspended disabled removed gone missing empty large memory execute process complete completed handle".split()
NO_SIGN = r"(not|no|cannot|can t|couldn t|could not|doesn t|don t|isn t|wasn t|aren t|longer|never|0)(( be| been| longer| yet| currently| able| to| have| available| right){0,3}) (found|available|exist|exists|respond|responding|response|answer|load|loaded|shown|displayed|displaying|opened|reached|reach|connect|connected|find|open|valid|allowed|permitted|authorized|authorised|accepted|acceptable|supported|working|work|complete|completed|handle|process|execute|permission|access|view|see|here|establish|logged)"
SIGN = r"(?<!\w)(unavailable|moved|removed|deleted|denied|refused|rejected|blocked|forbidden|unauthori[sz]ed|expired|invalid|errors?|failed|failure|fails|time ?out|timed out|took too long|overloaded|busy|down|offline|maintenance|bad (request|gateway|response)|went wrong|happened|unexpected|internal|crashed|reset|closed|terminated|aborted|(limit|time) (reached|exceeded)|exceeded|too many requests|technical|problems?|issues?|exception|fatal|stopped|hit|locked|suspended|disabled|gone|missing|too large|not found|out of memory|" + NO_SIGN + r")(?!\w)"
THING = r"(?<!\w)(pages?|links?|resource|document|files?|folder|directory|address|url|article|post|site|website|webpage|services?|servers?|host|gateway|database|system|application|app|requests?|session|access|connection|login|sign in|account|content|item|path|proxy|network|domain|certificate|token|permissions?|browser|object|user|password|image|video|product|method|something|errors?|exception|response|memory|zcode)(?!\w)"
# The same in Vietnamese, by syllable.
VI_WORDS = "trang web nay do ban quy khach dang tim kiem can yeu cau duong dan vua mo lien ket noi dung bai viet tai lieu tap tin may chu he thong dich vu cong ung phien lam viec dang nhap cua luot truy cap quyen khoan hien da bi khong tam thoi chua het duoc con ton o day thay go bo xoa chuyen di sang khac kha dung qua gap su co loi mat so du phan hoi bao tri ngung hoat dong gian doan han tu choi hop le khoa chan cho phep hay lai vui long luc thu sau trong tren den voi vi neu khi thi la va hoac nguoi quan mot it phut tra quay quyet ve lam on giay chut nua rat tiec xin the ra xay ma trinh duyet mang tam ngung hong may tinh thiet tro ve truoc chinh xac sai qua lau nhieu lan gioi trung tam ky thuat he lac hien thi tai".split()
VI_THING = r"(?<!\w)(trang|duong dan|lien ket|noi dung|bai viet|tai lieu|tap tin|may chu|he thong|dich vu|cong ket noi|ket noi|ung dung|phien|luot|yeu cau|truy cap|tai khoan|mang|loi|su co|trinh duyet)(?!\w)"
VI_SIGN = r"(?<!\w)((bi|da|duoc) (tu choi|chan|khoa|go|xoa|huy|gian doan|loi|chuyen|dong|ngat|mat)|het han|qua tai|gap (su co|loi)|(co|xay ra|gap) (loi|su co)|bao tri|ngung hoat dong|gian doan|mat ket noi|noi khac|khong (con |duoc |the |co )*(ton tai|o day|tim thay|thay|kha dung|hop le|phan hoi|truy cap|mo|tai|ket noi|cho phep|phep|hoat dong|hien thi|quyen|dung|chinh xac)|khong (con|co) (quyen|trang|o)|tu choi|loi (may chu|he thong|ket noi|mang|khong xac dinh|0|zcode)|(ma )?loi zcode)(?!\w)"
SCRIPT_NAMES = ["javascript", "js", "script", "scripts", "cookie", "cookies"]
SCRIPT_VI = "muc bieu mau phan chi hien du chay bat tat mo kich hoat thieu ho tro vo hieu xem de tiep tuc roi truoc phai can vao len hieu hoa doi cai dat".split()
SCRIPT_WORDS = "javascript java js script scripts cookie cookies enable enabled enabling allow allowed allowing turn turned turning switch switched switching activate activated unblock block blocked blocking disable disabled require required requires only on off start starts run runs work works working function functions properly correctly blank stays remains display show shown without continue proceed use using settings setting changing change experience best full features feature interactive seems looks like appears have ought order also all does".split()
SCRIPT_CUE = r"(?<!\w)(enabled?|enabling|disabled?|allow(ed|ing)?|requir(ed?|es)|support(ed|s)?|without|(un)?block(ed|ing)?|turn(ed|ing)? (on|off)|switch(ed|ing)? (on|off)|off|activated?|needs?|must|bat|tat|mo|chan|cho phep|kich hoat|yeu cau|ho tro|thieu|can|phai)(?!\w)"
#: Unlisted words, such as the name of an app, that a demand for scripts may hold.
SLACK = 2
# Checks before a page opens, which ask for no script by name.
GATE = r"checking (if )?(your browser|the site connection|you are human)( .*)?|(please )?(verify|confirm)( that)? you are( a| not a)? (human|robot)( by .*)?|verifying you are human( .*)?|dang kiem tra trinh duyet( .*)?|ban co phai( la)? (nguoi|robot)( .*)?|(please )?(enable|allow|turn on) (it|them) (to|and) (continue|proceed|reload|try again)( .*)?|reload( the page)? after (changing|enabling|allowing) .*|tai lai trang sau khi (bat|mo|doi) .*"
GATE_FIRST = "checking verifying verify confirm please enable allow turn reload dang ban tai".split()
# Talk of text to come: things that are written, and signs that they are not yet.
COMING = "your the this that a an some any of our to be will goes go comes come is are for in on and or here there now soon later below above sub main short long body text texts title titles headline heading subheading content copy paragraph paragraphs sentence line lines description caption quote image photo picture logo name section item page intro summary word words placeholder dummy sample filler example temporary temp draft mock insert add enter type write paste put edit replace replaced written updated filled added changed layout only just nothing real actual final click tap".split()
COMING_VI = "noi dung mau van ban giu cho tieu de o day mo ta ngan dai se viet sau nay de chu doan duoc thay the la thu tam cap nhat nhap vao tai them dang bo sung hinh anh vi du dong cau phu chua co chen dien ten muc gioi thieu can go minh hoa".split()
COMING_NOUN = r"(?<!\w)(texts?|titles?|(sub)?headline|(sub)?heading|content|copy|paragraphs?|sentence|lines?|description|caption|image|photo|picture|logo|intro|summary|words?|noi dung|van ban|tieu de|mo ta|chu|doan|cau|hinh anh|anh)(?!\w)"
COMING_SIGN = r"(?<!\w)(here|placeholder|dummy|sample|filler|to come|comes?|coming|replaced?|insert|later|soon|temporary|mock|to be|mau|giu cho|(viet|thay|de chu|cap nhat|bo sung|them|dien|chen) sau|chu sau|se (viet|thay|duoc|cap nhat|bo sung|them)|dang (duoc )?cap nhat|thu|tam|tai day|vao day|o day|minh hoa)(?!\w)"
MENU = [
    "(home|start)( ?page)?", "(return|go( back)?) (to )?(the )?(home( ?page)?|start page|previous page)", "skip to (main )?content", "subscribe", "follow us", "read more", "loading", "nginx( 0)*", "apache( 0)*( .* server at .* port 0)?", "cloudflare( ray id)?( zhex)?", "about( us)?", "help", "contact( us)?", "sign in", "sign up", "log ?in", "log ?out", "register", "menu", "search", "back( to (the )?(home( ?page)?|top))?", "next", "previous", "news", "faq", "terms( of (use|service))?", "privacy( policy| settings)?", "cookie (policy|settings)", "all rights reserved", "contact the administrator", "site ?map", "copyright", "powered by \\w+", "version 0( 0)*", "ref(erence)? 0",
    "(quay )?(ve|lai) trang (chu|truoc)", "xem them", "trang chu", "tin moi", "lien he", "gioi thieu", "dang nhap", "dang ky", "dang xuat", "quay lai", "tro ve", "tim kiem", "tro giup", "chinh sach rieng tu", "dieu khoan su dung", "phien ban 0( 0)*", "ban quyen( thuoc ve)?",
    "rat tiec", "xin loi( quy khach| ban)?", "(we are |we re )?(so )?sorry", "oops", "whoops", "vui long thu lai sau( it phut)?", "please try again( later)?", "try again later", "\\w* ?mot chut nua thoi", "please wait", "just a moment", "(please )?(log|sign) ?in again", "(please )?check (your|the) (internet |network )?(connection|address|url|spelling)( and try again)?", "vui long kiem tra( lai)?( ket noi| mang| duong truyen| duong dan| internet)*", "(click|tap) (here )?to (edit|change|add)( \\w+)*", "vui long (cho|doi)( trong giay lat)?", "0", "c 0", "(ma loi|code|ref(erence)?|ma theo doi|ma tham chieu|ma su co|tracking (code|id|number)|(request|incident|trace|event|ray|case) id|ma yeu cau)( (zhex|zcode|0))+",
]

#: First words of the patterns above.
MENU_FIRST = "home start homepage return go skip subscribe follow read loading nginx apache cloudflare about help contact sign signup signin log login logout register menu search back next previous news faq terms privacy cookie all sitemap site copyright powered version ref reference quay ve lai xem trang tin lien gioi dang tro tim chinh dieu phien ban rat xin we so sorry oops whoops vui please try just click tap check 0 c ma code tracking request incident trace event ray case zaddress".split()

# Looser cues for segments that recur. "loi" alone is no cue: without accents it is also a word of speech or gain.
_ERROR_CUE = r"error|exception|fail(ed|ure|s)?|denied|forbidden|unauthori[sz]ed|not found|can(not| t) be (found|reached|displayed|loaded)|could not be (found|reached|displayed|loaded|opened)|unavailable|time ?out|timed out|refused|rejected|expired|overloaded|went wrong|bad (gateway|request)|under maintenance|no longer (exists?|available)|(http|status|code|err|ma|loi|trang thai) zcode|zcode (http|status|code|err|ma|loi)|(bi|gap|co|xay ra|ma) loi|loi (may chu|he thong|ket noi|mang|trang|tai|0)|su co|qua tai|dang bao tri|khong (tim thay|ton tai|kha dung|truy cap duoc|the (tai|mo|ket noi|truy cap))|bi (tu choi|chan|gian doan)|het han"
_FILLER_CUE = ["placeholder", "dummy", "filler", "sample", "headline", "giu", "mau"]
#: Words of a narrator: a segment with one tells of a message.
_TOLD = r"i|he|she|they|who|why|which|said|says|say|asked?|asks|told|tells?|explain(ed|s)?|wrote|writes?|saw|showed|shows|made|makes|solved|fixed|agreed|laughed|thought|yesterday|last (night|week|month|year)|(we|the team) (had|have|got|found|use[ds]?|were)|nobody|everyone|toi|minh|anh ay|co ay|ho(?! tro)|nguoi ta|ban nao|nguoi nao|ai|hom (qua|nay|truoc|kia)|(sang|chieu|toi) (nay|qua)|ca (buoi|ngay)|cuoi cung|hoa ra|noi rang|bao rang|ke rang|giai thich|tai sao|vi sao|se thay"
#: A segment of more words tells something.
MESSAGE_WORDS = 20

#: Page furniture has at most so many words, and none of these: what a sentence is made with (accents dropped).
FURNITURE_WORDS = 6
_SENTENCE = r"i|he|she|they|we|it|you|is|are|was|were|am|be|been|has|have|had|do|does|did|will|would|shall|should|may|might|must|said|says|asked|that|which|who|because|toi|minh|chung toi|chung ta|la|da|dang|se|roi|duoc|bi|khong|chua|nhe|nhi|thi|ma|vi|nen|neu"


def bare(col: Column) -> Column:
    """Lower case without Vietnamese accents."""
    return F.translate(F.lower(col), "".join(PLAIN.values()), "".join(k * len(v) for k, v in PLAIN.items()))


def consistent(col: Column) -> Column:
    return F.when(has_beyond_ascii(col), unified(col)).otherwise(col)


def open_slot(col: Column) -> Column:
    """Whether a slot stands open in a text: outside quotation and code marks."""
    maybe = col.rlike(r"[{\[<@%#_]")
    return maybe & F.regexp_replace(col, QUOTED, " ").rlike(SLOT)


def normalised(parts: Column) -> Column:
    """The masked forms of an array of segments, for the exact hash: letters and 0 between single blanks.
    One step after the other over the array, so that no step is repeated within the next."""
    steps = [
        bare,
        lambda s: F.when(F.contains(s, F.lit("/")) | F.contains(s, F.lit("@")) | F.contains(s, F.lit("www.")), F.regexp_replace(s, r"\b(https?://|www\.)\S+|\S+@\S+\.\w+|(?<!\S)/[\w./-]+", " zaddress ")).otherwise(s),
        lambda s: F.when(s.rlike("[0-9]"), _numbers(s)).otherwise(s),
        lambda s: F.trim(F.regexp_replace(s, r"[^\p{L}0]+", " ")),
    ]
    for step in steps:
        parts = F.transform(parts, step)
    return parts


def _numbers(s: Column) -> Column:
    s = F.regexp_replace(s, r"\b\d{1,4}[-/.:]\d{1,2}([-/.:]\d{1,4})?\b", " 0 ")
    s = F.regexp_replace(s, r"\b(?=[a-f]*\d)[0-9a-f]{6,}\b", " zhex ")
    s = F.regexp_replace(s, r"(?<![\w])[45]\d\d(?![\w])", " zcode ")
    return F.regexp_replace(s, r"\d+", "0")


def _count(words: Column, of: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(of)))


def _only(words: Column, *of: list[str]) -> Column:
    """Whether all words are listed; the first that is not ends the search."""
    return F.forall(words, lambda w: w.isin(sorted({x for part in of for x in part})))


def prepared(segment: Column) -> Column:
    """A normalised segment with its words, and how many are keys pressed at random or dummy Latin."""
    words = F.split(segment, " ")
    return F.struct(segment.alias("text"), words.alias("words"), _count(words, MASH).alias("mash"), _count(words, [*LATIN, *LATIN_MORE]).alias("dummy"))


def kind_of(x: Column) -> Column:
    """The kind of a prepared segment: error, script, filler, furniture or null."""
    segment, words = x["text"], x["words"]
    whole = lambda p: segment.rlike(f"^({p})$")
    has = lambda *of: reduce(lambda a, b: a | b, [F.contains(segment, F.lit(w)) for w in of])
    listed = lambda *of: "|".join(sorted({x for part in of for x in part}, key=len, reverse=True))
    # Possessive repeats of whole words: time is linear in a segment of any length, and no stack grows.
    run = lambda p: rf"(?:(?:{p})(?: |$))++"
    code = r"((http|error|err|status|loi|ma loi) ){0,4}zcode|zhex"
    named = has("script", "js", "cookie") & F.exists(words, lambda w: w.isin(SCRIPT_NAMES))
    demand = sorted({w for part in (GLUE, THINGS, SCRIPT_WORDS, VI_WORDS, SCRIPT_VI) for w in part})
    script = (named & segment.rlike(SCRIPT_CUE) & (F.size(F.filter(words, lambda w: ~w.isin(demand))) <= SLACK) & ~segment.rlike(rf"(?<!\w)({_TOLD})(?!\w)")) | (words[0].isin(GATE_FIRST) & whole(GATE))
    message = _only(words, GLUE, THINGS, SIGNS, VI_WORDS)
    error = message & ((segment.rlike(SIGN) & segment.rlike(THING)) | (segment.rlike(VI_SIGN) & segment.rlike(VI_THING)))
    fill = sorted({*COMING, *COMING_VI, *MASH, *LATIN, *LATIN_MORE})
    coming = F.forall(words, lambda w: w.isin(fill) | w.rlike(PRESSED)) & segment.rlike(COMING_NOUN) & segment.rlike(COMING_SIGN)
    n, sure = F.size(words), x["mash"] + x["dummy"]
    pressed = (sure > 0) | has("xxx", "zzz", "aaa", "asdf", "qwer", "zxcv", "hjkl", "sdfg", "dfgh", "fdsa")
    mashed = pressed & whole(run(listed(MASH, LATIN, LATIN_MORE, LATIN_TOO, ["0", "x{3,}", "z{3,}", "a{3,}", "(?:asdf|qwer|zxcv|hjkl|sdfg|dfgh|fdsa){2,}"])))
    mostly = (n >= 6) & (sure >= 0.5 * n) & (sure + _count(words, LATIN_TOO) >= 0.8 * n)
    return (
        F.when((words[0].isin(MENU_FIRST) | has("mot chut nua thoi")) & whole(run(listed(MENU, ["zaddress"]))), "furniture")
        .when(script, "script")
        .when((has("zcode", "zhex") & whole(code)) | error, "error")
        .when(mashed | mostly | ((n >= 3) & (words[0] == words[1]) & whole(r"(\w++)(?: \2(?= |$)){2,}+")) | (coming & (n >= 3)), "filler")
    )


def loose_kind_of(segment: Column) -> Column:
    """The kind of a normalised segment that recurs widely and fits no rule: error, script, filler or null."""
    holds = lambda p: segment.rlike(rf"(?<!\w)({p})(?!\w)")
    words = F.split(segment, " ")
    n = F.size(words)
    message = (n <= MESSAGE_WORDS) & ~holds(_TOLD)
    filler = F.size(F.filter(words, lambda w: w.isin([*MASH, *LATIN, *LATIN_TOO, *_FILLER_CUE])))
    certain = F.exists(words, lambda w: w.isin([*MASH, *LATIN, *_FILLER_CUE[:3]]))
    return F.when(message & F.exists(words, lambda w: w.isin(SCRIPT_NAMES)) & segment.rlike(SCRIPT_CUE), "script").when(message & holds(_ERROR_CUE), "error").when((n >= 3) & (filler >= 0.5 * n) & certain, "filler")


def furniture_like(segment: Column) -> Column:
    """Whether a normalised segment has the form of page furniture: few words, no sentence."""
    return (F.size(F.split(segment, " ")) <= FURNITURE_WORDS) & ~segment.rlike(rf"(?<!\w)({_SENTENCE})(?!\w)")


class Residue:
    """texts: (key, source, slot, segments: array of (hash, text, dummy, kind)), written once; known: (hash, kind) of the
    segments whose kind comes from the corpus; templates, found, kept: see there."""

    def __init__(self, df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> None:
        """Rows without a key or with a null or empty text have no part; rows of equal keys count as one text."""
        t = df.select(F.col(key).alias("key"), F.col(source).alias("source"), consistent(F.col(text)).alias("text")).where("key is not null and text is not null and text != ''")
        parts = F.split("text", r"[\n\r|•·›»]+|(?<=[.!?…])\s+")
        segments = F.filter(F.array_distinct(normalised(parts)), lambda x: x != "")
        # The generator keeps the optimizer from normalising again in every place that uses the segments.
        t = t.select("key", "source", open_slot(F.col("text")).alias("slot"), F.explode(F.array(segments)).alias("_s"))
        self.texts = write_table(t.select("key", "source", "slot", F.transform(F.transform("_s", prepared), lambda x: F.struct(F.xxhash64(x["text"]).alias("hash"), x["text"].alias("text"), x["dummy"].alias("dummy"), kind_of(x).alias("kind"))).alias("segments")), "segments")
        self.known = write_table(self._recurring().unionByName(self._dummy()).groupBy("hash").agg(F.min("kind").alias("kind")), "kinds")

    def _rows(self, *cols: str) -> DataFrame:
        return self.texts.select(*cols, F.explode("segments").alias("s"))

    def _grouped(self, rows: DataFrame) -> DataFrame:
        """(hash, docs, sources): by source first, so that a segment which a third of all texts hold is counted where it is read."""
        g = rows.groupBy(F.col("s.hash").alias("hash"), "source").agg(F.count("*").alias("docs"))
        return g.groupBy("hash").agg(F.sum("docs").alias("docs"), F.count("*").alias("sources"))

    def _recurring(self) -> DataFrame:
        """(hash, kind) of segments of no kind that recur widely, by looser cues. Only hashes are shuffled;
        the texts are fetched for those that recur."""
        of = self.texts.groupBy("source").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("texts"), F.count("*").alias("sources")).first()
        recurs = lambda texts, sources: (F.col("docs") >= max(LEAST, texts * of.texts)) & (F.col("sources") >= max(LEAST, sources * of.sources))
        rows = self._rows("source").where("s.kind is null")
        g = self._grouped(rows).select("hash", recurs(MESSAGE_TEXTS, MESSAGE_SOURCES).alias("m"), recurs(FURNITURE_TEXTS, FURNITURE_SOURCES).alias("f")).where("m or f")
        d = rows.select(F.col("s.hash").alias("hash"), F.col("s.text").alias("text")).join(small(write_table(g, "recurring")), "hash").groupBy("hash").agg(F.min("text").alias("text"), F.max("m").alias("m"), F.max("f").alias("f"))
        kind = F.coalesce(F.when(F.col("m"), loose_kind_of(F.col("text"))), F.when(F.col("f") & furniture_like(F.col("text")), "furniture"))
        return d.select("hash", kind.alias("kind")).where("kind is not null")

    def _dummy(self) -> DataFrame:
        """(hash, kind) of segments made of dummy words that the corpus teaches."""
        known = [*LATIN, *LATIN_MORE]
        words = F.split("s.text", " ")
        rows = self._rows("source").select(F.col("s.hash").alias("hash"), F.col("s.dummy").alias("dummy"), words.alias("words"))
        near = rows.where((F.col("dummy") >= SEEDS) & (F.col("dummy") >= SEED_SHARE * F.size("words"))).select(F.explode(F.array_distinct("words")).alias("word")).where(~F.col("word").isin(known) & (F.char_length("word") > 2))
        beside = write_table(near.groupBy("word").agg(F.count("*").alias("beside")).where(F.col("beside") >= LEAST).select("word"), "beside")
        every = rows.select(F.explode("words").alias("word"), (F.col("dummy") == 0).alias("alone")).join(small(beside), "word").groupBy("word").agg(F.count("*").alias("all"), F.count_if("alone").alias("alone"))
        learned = write_table(every.where(F.col("alone") <= STRAY * F.col("all")).select("word"), "dummy")
        some = self._rows("key").where("s.kind is null").select("key", F.col("s.hash").alias("hash"), F.size(words).alias("n"), F.explode(words).alias("word")).join(small(learned), "word")
        taught = some.groupBy("key", "hash").agg(F.count("*").alias("k"), F.max("n").alias("n")).select("hash", "k").distinct()
        d = self._rows("key").where("s.kind is null").select(F.col("s.hash").alias("hash"), F.split("s.text", " ").alias("w")).join(small(taught), "hash")
        sure = F.col("k") + _count(F.col("w"), known)
        # Or dummy words among keys pressed at random and talk of text to come.
        fill = sorted({*known, *MASH, *COMING, *COMING_VI})
        among = (sure >= SEEDS) & (F.col("k") + F.size(F.filter("w", lambda w: w.isin(fill) | w.rlike(PRESSED))) >= 0.9 * F.size("w"))
        enough = (sure >= DUMMY * F.size("w")) | among
        return d.where(enough & (F.size("w") >= 3)).select("hash", F.lit("filler").alias("kind")).distinct()

    def templates(self) -> DataFrame:
        """(hash, docs, sources, segment, kind) of every distinct segment of a kind."""
        rows = self._rows("source").join(small(self.known.withColumnRenamed("kind", "taught")), F.col("s.hash") == F.col("hash"), "left").where("s.kind is not null or taught is not null")
        text = rows.groupBy("s.hash").agg(F.min("s.text").alias("segment"), F.min(F.coalesce("s.kind", "taught")).alias("kind"))
        return self._grouped(rows.drop("hash")).join(text, "hash").select("hash", "docs", "sources", "segment", "kind")

    def found(self) -> DataFrame:
        """(key, slot, kinds): the texts to leave out, with the kinds of their segments."""
        rows = self.texts.select("key", "slot", F.explode_outer("segments").alias("s"))
        rows = rows.select("key", "slot", F.col("s.hash").alias("hash"), F.col("s.kind").alias("own")).join(small(self.known), "hash", "left").withColumn("kind", F.coalesce("own", "kind"))
        has = lambda k: F.coalesce(F.max(F.col("kind") == k), F.lit(False)).alias(k)
        kinds = ["error", "filler", "furniture", "script"]
        g = rows.groupBy("key").agg(F.max("slot").alias("slot"), F.max(F.col("hash").isNotNull() & F.col("kind").isNull()).alias("ordinary"), *[has(k) for k in kinds])
        waste = ~F.col("ordinary") & (F.col("error") | F.col("filler") | F.col("script"))
        names = F.filter(F.array(*[F.when(F.col(k), k) for k in kinds]), lambda x: x.isNotNull())
        return g.where(F.col("slot") | waste).select("key", "slot", names.alias("kinds"))

    def kept(self, df: DataFrame, key: str = "doc_id") -> DataFrame:
        """df without the texts found."""
        return df.join(self.found().select(F.col("key").alias(key)), key, "left_anti")
