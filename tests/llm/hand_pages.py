"""Twenty pages written by hand, with their main text: noise inside articles, layouts by tables, pages without holders."""

MAIN = {
    "en": ("The harbour at dawn", ["Fishermen had been at work since four in the morning, and the first crates of herring stood on the quay before the sun was up.", "Prices have fallen for the third year in a row. Many of the smaller boats no longer leave the harbour at all.", "“We will stay as long as we can,” said the owner of the oldest boat, who learned the trade from her grandfather."]),
    "de": ("Der Winter im Tal", ["Seit drei Wochen liegt der Schnee so hoch, dass die Straße nur am Vormittag geräumt werden kann.", "Die Schule hat ihre Stunden verlegt, und wer im oberen Dorf wohnt, kommt mit dem Schlitten. Das war schon früher so.", "Im Frühjahr wird man sehen, was von den Zäunen übrig geblieben ist."]),
    "fr": ("Le marché du samedi", ["Dès six heures, les maraîchers installent leurs étals sous les platanes, et les premiers clients arrivent avant le jour.", "On y trouve des légumes de saison, du miel de montagne et, en automne, des champignons que les habitants ramassent eux-mêmes.", "La mairie voudrait déplacer le marché, mais personne ici ne veut en entendre parler."]),
    "es": ("Una biblioteca nueva", ["El barrio esperó más de diez años hasta que por fin se abrieron las puertas de la biblioteca.", "Los niños ocuparon enseguida la sala del fondo, donde hay cojines y una ventana que da al jardín. Nadie quiso marcharse.", "El edificio fue antes una fábrica de hilos, y en las paredes todavía se leen los nombres de las máquinas."]),
}
TEXT = {k: "\n".join([t, *ps]) for k, (t, ps) in MAIN.items()}


def body(lang, between=("", "", "", "")):
    title, ps = MAIN[lang]
    return f"<h1>{title}</h1>{between[0]}<p>{ps[0]}</p>{between[1]}<p>{ps[1]}</p>{between[2]}<p>{ps[2]}</p>{between[3]}"


NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li></ul></nav>'
FOOT = "<footer><p>© 2024 Daily Harbour. All rights reserved.</p><p><a href='/privacy'>Privacy</a> <a href='/imprint'>Imprint</a></p></footer>"
COMMENTS = """<section class="comments"><h3>3 comments</h3><div class="comment"><b>Anna</b> <p>I grew up there and it was just the same forty years ago.</p></div><div class="comment"><p>Thanks for this lovely piece, I shared it with my sister.</p></div></section>"""
RELATED = '<aside class="related"><h4>Related</h4><ul><li><a href="/a">Storm damages the old pier</a></li><li><a href="/b">A new school for the island</a></li></ul></aside>'
NOTICE = '<div class="cookie-notice"><p>We use cookies to improve your visit. By going on you accept our settings.</p><button>Accept</button></div>'
FORM = '<form class="newsletter" action="/s"><label>Your email</label><input name="e"><button>Subscribe</button></form>'
AD = '<div class="ad">Save 30% on all winter boots this week only!</div>'
SHARE = '<ul class="social"><li><a href="#">Share</a></li><li><a href="#">Tweet</a></li><li><a href="#">Print</a></li></ul>'
SIDE = '<div class="sidebar"><h3>Most read</h3><ul><li><a href="/1">Ten walks along the coast</a></li><li><a href="/2">Where the bus no longer stops</a></li></ul></div>'


def page(inner):
    return f"<!DOCTYPE html><html><head><title>x</title><script>var a='<p>no</p>'</script></head><body>{inner}</body></html>"


PAGES = [
    (page(NAV + f"<article>{body('en', ('', '', RELATED, ''))}</article>" + FOOT), TEXT["en"]),
    (page(NAV + f"<article>{body('de', ('', '', '', COMMENTS))}</article>" + FOOT), TEXT["de"]),
    (page(NAV + f"<main>{body('fr', (SHARE, AD, '', RELATED))}</main>" + FOOT), TEXT["fr"]),
    (page(NAV + f"<article>{body('es', (NOTICE, '', FORM, COMMENTS))}</article>" + SIDE + FOOT), TEXT["es"]),
    (page(f"<table><tr><td class='menu'><a href='/'>Home</a><br><a href='/n'>News</a></td><td>{body('en')}</td></tr></table>"), TEXT["en"]),
    (page(f"<table width='100%'><tr><td colspan=2><b>Welcome to our site</b></td></tr><tr><td><ul><li><a href='/'>Start</a></li><li><a href='/k'>Kontakt</a></li></ul></td><td class='text'>{body('de')}</td></tr><tr><td colspan=2><small>Impressum | Datenschutz</small></td></tr></table>"), TEXT["de"]),
    (page(body("fr")), TEXT["fr"]),
    (page(NAV + body("es") + FOOT), TEXT["es"]),
    (page(body("en") + SIDE), TEXT["en"]),
    (page(NAV + f"<div id='content'><div class='post'>{body('de', ('', AD, '', FORM))}</div>{COMMENTS}</div>" + FOOT), TEXT["de"]),
    (page(NAV + f"<main><article>{body('fr')}<footer>Posted in <a href='/c'>Markets</a></footer></article></main>" + FOOT), TEXT["fr"]),
    (page(NOTICE + NAV + f"<section class='story'>{body('es', ('', RELATED, '', SHARE))}</section>" + SIDE + FOOT), TEXT["es"]),
    (page(f"<article>{body('en', ('', '', '', '<div id=comments>' + COMMENTS + '</div>'))}</article>"), TEXT["en"]),
    (page(NAV + f"<div class='content'>{body('de', ('', NOTICE, RELATED, ''))}</div>" + FORM + FOOT), TEXT["de"]),
    (page(NAV + f"<article><div>{body('fr', ('', '<aside><p>Sign up for our newsletter and never miss a story again.</p></aside>', '', ''))}</div></article>" + FOOT), TEXT["fr"]),
    (page(f"<header><a href='/'>El Diario</a></header>{NAV}<article>{body('es')}</article><section class='comments'><p>¡Qué bonito artículo, gracias!</p></section>{FOOT}"), TEXT["es"]),
    (page(NAV + f"<article>{body('en', (AD, AD, AD, AD))}</article>" + FOOT), TEXT["en"]),
    (page(f"<table><tr><td>{NAV}</td><td><font>{body('es')}</font></td><td>{SIDE}</td></tr></table>"), TEXT["es"]),
    (page(NAV + SIDE + FOOT), ""),
    (page(f"<nav class='breadcrumb'><a href='/'>Home</a> &gt; <a href='/c'>Coast</a></nav><div id=main>{body('de', ('', '', '', SHARE + RELATED + COMMENTS + FORM))}</div>" + FOOT), TEXT["de"]),
]
