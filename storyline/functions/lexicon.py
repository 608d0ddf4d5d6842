"""Word lists and limits of the engine's rules. Lists are parameters of the functions that use them; these are the defaults."""

from __future__ import annotations

from dataclasses import dataclass

# Query parameters that say where a link was clicked, not what it leads to.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "medium", "mc_cid", "mc_eid"]

# Identifiers of actors, vulnerabilities and advisories.
ACTOR_ID = (
    r"(?i)\b(?:unc\d{3,5}|uat-?\d{3,5}|uac-\d{3,4}|tag-\d{2,4}|cl-(?:sta|cri|unk)-\d{3,4}|dev-\d{3,5}|storm-\d{3,5}|apt[\s-]?\d{1,3}|ta\d{3,4}|fin\d{1,2}"
    r"|cve-\d{4}-\d{4,7}|ghsa-[0-9a-z]{4}-[0-9a-z]{4}-[0-9a-z]{4})\b"
)
ADVISORY_ID = (
    r"(?i)\b(?:cert[\s-]?(?:fr|eu|ua|bund|in|ee)[\s-]?\d{4}[\s-]?[a-z]{2,4}[\s-]?\d+|icsa?[\s-]?\d{2}[\s-]?\d{3}[\s-]?\d{2}[a-z]?|icsma[\s-]?\d{2}[\s-]?\d{3}[\s-]?\d{2}"
    r"|vu#\s?\d{4,}|msrc[\s-]?\d{4,}|kb\d{6,}|vmsa[\s-]?\d{4}[\s-]?\d{4}|rhsa[\s-]?\d{4}:\d+|dsa[\s-]?\d{4}[\s-]?\d|usn[\s-]?\d{4}[\s-]?\d)\b"
)
ACTOR_SUFFIXES = (
    "Bear Panda Kitten Chollima Spider Jackal Buffalo Tiger Leopard Crane Lynx Blizzard Typhoon Sandstorm Sleet Tempest Cyclone Hail Dust Flood Rain Storm Wolf Dragon Serpent Scorpion"
).split()
ACTOR_SUFFIX_DENY = ["arcticwolf", "comododragon", "chinesedragon", "operationdragon"]
NAMED_ACTORS = [
    "star blizzard", "sandworm", "lazarus", "fancy bear", "cozy bear", "midnight blizzard", "cozy", "turla", "kimsuky", "andariel", "kontti", "salt typhoon", "volt typhoon",
    "flax typhoon", "silk typhoon", "lockbit", "blackcat", "alphv", "cl0p", "clop", "scattered spider", "shinyhunters", "fin7", "wizard spider", "gamaredon", "mustang panda",
    "charming kitten", "apt28", "apt29", "apt40", "apt41", "pegasus", "nso group", "intellexa", "predator", "candiru", "cytrox", "quadream", "finfisher",
]

# Product and platform names that look like code names.
CODENAME_DENY = (
    "fortigate fortinet fortios fortisandbox fortiweb fortimanager windows microsoft macos ipados iphone iphones ipad ipads github gitlab linkedin whatsapp youtube facebook instagram "
    "openai chatgpt powershell javascript typescript nodejs wordpress bleepingcomputer crowdstrike virustotal cloudflare paypal mongodb postgresql mysql kubernetes dropbox onedrive "
    "sharepoint teamviewer anydesk lastpass bitlocker sentinelone sonicwall paloalto checkpoint proofpoint mimecast manageengine autogen deepseek blackberry quickbooks salesforce "
    "servicenow pytorch tensorflow macbook airpods playstation cobalt anyconnect cloudstrike androidos"
).split()
ACRONYM_DENY = (
    "https oauth mitre owasp hipaa ransom malware threat attack exploit botnet phish alert update report breaking notice warning critical advisory bulletin security privacy network "
    "server router backdoor trojan spyware stealer loader ransomware breach leaked hacked linux chrome google apple adobe cisco oracle azure intel nvidia amazon nginx apache ubuntu "
    "debian europol interpol russia china iran korea ukraine certfr certeu certua certbund icsa icsma msrc asyncapi openapi graphql restapi webassembly websocket jsonschema openssl "
    "openssh openstack openshift siber guvenlik saldiri zararli yazilim devlet hukumet kurum rapor uyari turkiye system systems winsock techcrunch bloomberg reuters wired webgl webrtc "
    "webhook webview"
).split()

# Words that say nothing of an event.
STOP_WORDS = (
    "ve ile bir bu şu için olan olarak gibi daha çok ancak ası göre kadar sonra önce her tüm veya ya de da ki ise hem ne en ait üzere tarafından arasında içinde üzerinde yönelik karşı "
    "edilmiştir edildiği olduğu olduğunu belirtilmektedir bildirilmektedir yapılmıştır etmiştir etmektedir açıklamıştır duyurmuştur tespit söz konusu ayrıca ilgili amacıyla the and of to "
    "in a an is are for on by with as at from that this it its has have was were be been or into their they which said new also using used use after over than who multiples multiple "
    "vulnérabilités vulnerabilites vulnérabilité vulnerabilite dans pour avec sur les des une aux par est sont plusieurs noyau janvier février fevrier mars avril juin juillet août aout "
    "septembre octobre novembre décembre decembre"
).split()

# Signs of a package ecosystem, and how far from one a package's name may stand.
ECOSYSTEM = (
    r"npm|pypi|pip|packagist|composer|nuget|rubygems|crates|cargo|maven|gradle|homebrew|vsix|paket|paketi|paketine|paketleri|paketlerine|paketlerinin|kütüphane|kütüphanesi|kütüphaneleri"
    r"|registry|repository|depo|deposu"
)
PACKAGE_WINDOW = 90
BULLETIN = r"(?i)multiples?\s+vuln[ée]rabilit[ée]s?\s+dans\s+(.+?)(?:\s*\(|$)"
BULLETIN_FILL = "le la les de du des un une et noyau produits produit".split()


@dataclass(frozen=True)
class Lexicon:
    """Lists that depend on the corpus: deny lists of packages, entities and story stems come from the user's configuration."""

    named_actors: tuple[str, ...] = tuple(NAMED_ACTORS)
    codename_deny: tuple[str, ...] = tuple(CODENAME_DENY)
    acronym_deny: tuple[str, ...] = tuple(ACRONYM_DENY)
    stop_words: tuple[str, ...] = tuple(STOP_WORDS)
    package_deny: tuple[str, ...] = ()
    entity_deny: tuple[str, ...] = ()
    story_deny: tuple[str, ...] = ()


# Thresholds of the event rules.
TOPIC_ALONE, TOPIC_ACTOR, TOPIC_ACTOR_XDAY, TOPIC_PACKAGE, TOPIC_ENTITY = 0.42, 0.10, 0.14, 0.22, 0.22
TITLE_SAME_RUN, TITLE_XDAY, TOPIC_TITLE_XDAY = 0.62, 0.74, 0.20
LEAD_STEMS, LEAD_WORDS, BODY_CHARS = 40, 60, 2000
GENERIC_SHARE, LEAST_CORPUS, SHARED_NAMES, NEW_NAMES, HEADLINE_TOPIC, SUSPICIOUS_TOPIC = 0.03, 25, 2, 3, 0.25, 0.20

# Scoring. Points at most by dimension; priority by category; categories that can't be headlines, are vulnerabilities, or have no points.
POINTS = {"strategic": 40, "impact": 25, "urgency": 20, "trust": 15}
CATEGORIES = {
    "casus_yazilim": 9, "nation_state_apt": 8, "stratejik_kurum_saldirisi": 7, "politika_hukuk": 7, "tedarik_zinciri": 5, "kolluk_operasyonu": 5, "yapay_zeka_guvenligi": 4,
    "veri_ihlali": 3, "zafiyet_aktif_apt": 2, "zafiyet_rutin": 1, "phishing_sosyal_muhendislik": 1, "urun_icerik": 0, "siber_disi": 0,
}
NOT_HEADLINE = ["zafiyet_rutin", "urun_icerik", "siber_disi"]
VULNERABILITY = ["zafiyet_rutin", "zafiyet_aktif_apt"]
NO_POINTS = ["urun_icerik", "siber_disi"]
