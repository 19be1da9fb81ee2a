"""Pages written by hand, outside the training grammar: html and the blocks that are main text."""

PAGES = [
    (
        '<html><body><div class="lnks"><a href=/>Home</a> <a href=/n>News</a></div><div class=bdy><h1>Rain over the valley</h1><p>The rain began on Monday and did not stop until the river had left its bed.'
        "<p>People from three villages moved their animals to higher ground, helped by soldiers.<p>By Friday the water was gone.</div><div class=ft>&copy; 2021 Valley Times</div></body></html>",
        ["Rain over the valley", "The rain began on Monday and did not stop until the river had left its bed.", "People from three villages moved their animals to higher ground, helped by soldiers.", "By Friday the water was gone."],
    ),
    (
        "<html><body><table width=100%><tr><td><a href=/>Home</a><td><a href=/about>About</a><td><a href=/c>Contact</a></tr></table><table><tr><td><h2>How to prune roses</h2><p>Roses are cut back in early spring, when the buds begin to swell and hard frost is over."
        "<p>Use sharp, clean shears and cut just above a bud that faces outward.</td></tr></table><table><tr><td>Copyright 1999 by the garden club. All rights reserved.</td></tr></table></body></html>",
        ["How to prune roses", "Roses are cut back in early spring, when the buds begin to swell and hard frost is over.", "Use sharp, clean shears and cut just above a bud that faces outward."],
    ),
    (
        "<html><body><main><h1>Ein neues Museum</h1><p>Die Stadt eröffnet im Herbst ein Museum für Uhren, das in einer alten Fabrik untergebracht ist.</p><p>Der Eintritt bleibt im ersten Jahr frei.</p></main>"
        '<section class="thread"><h3>Kommentare</h3><div><p>Anna schreibt:</p><p>Endlich! Ich freue mich sehr darauf.</p></div><div><p>Gast</p><p>Wo kann man parken?</p></div></section><footer>Impressum | Datenschutz</footer></body></html>',
        ["Ein neues Museum", "Die Stadt eröffnet im Herbst ein Museum für Uhren, das in einer alten Fabrik untergebracht ist.", "Der Eintritt bleibt im ersten Jahr frei."],
    ),
    (
        '<html><body><div style="display:none"><p>You should never see this sentence, it is not shown.</p></div><div hidden>Nor this one.</div><article><h1>Tides</h1><p>The moon pulls the oceans toward it, and the far side bulges as well.</p>'
        "<p>Twice a day <span style='visibility: hidden'>secret words</span> the water rises on most coasts.</p></article></body></html>",
        ["Tides", "The moon pulls the oceans toward it, and the far side bulges as well.", "Twice a day the water rises on most coasts."],
    ),
    (
        '<html><body><div id="hd"><span>The Daily Harbor</span></div><ul><li><a href="/w">World</a><li><a href="/s">Sport</a><li><a href="/k">Culture</a></ul><div id="c1"><h1>Ferry line to open in June</h1><p>A new ferry will link the two banks of the estuary from June, the port authority said on Tuesday.</p>'
        '<p>Tickets cost two coins, and bicycles travel free.</p><div class="zz">Advertisement<p>Buy now: rain coats, 50% off!</p></div><p>The crossing takes eleven minutes in calm weather.</p></div><div id="r"><h3>Most read</h3><a href="/1">Storm closes bridge</a><br><a href="/2">Market moves</a></div></body></html>',
        ["Ferry line to open in June", "A new ferry will link the two banks of the estuary from June, the port authority said on Tuesday.", "Tickets cost two coins, and bicycles travel free.", "The crossing takes eleven minutes in calm weather."],
    ),
    (
        "<html><body><form><label>Search</label><input name=q><button>Go</button></form><div><div><h1>Bread without kneading</h1><p>Mix flour, water, salt and a little yeast, and leave the dough overnight.</p><ul><li>400 g of flour</li><li>300 g of water</li><li>8 g of salt</li></ul>"
        "<p>In the morning, heat a pot in the oven and bake the dough in it for forty minutes.</p></div></div><div>We use cookies to improve your experience. <button>Accept all</button></div></body></html>",
        ["Bread without kneading", "Mix flour, water, salt and a little yeast, and leave the dough overnight.", "400 g of flour", "300 g of water", "8 g of salt", "In the morning, heat a pot in the oven and bake the dough in it for forty minutes."],
    ),
    (
        "<html><body><p><a href=/>Start</a> | <a href=/a>Archive</a> | <a href=/m>Mail</a></p><h1>Notes on a bridge</h1><p>The bridge was built in 1874 by two brothers who had never built one before.</p><blockquote>It will stand for ever, said the mayor.</blockquote><p>It stood for nine years.</p><p>&copy; 2003</p></body></html>",
        ["Notes on a bridge", "The bridge was built in 1874 by two brothers who had never built one before.", "It will stand for ever, said the mayor.", "It stood for nine years."],
    ),
    (
        '<html><body><div class="x"><div class="y"><div class="z"><h2>Pourquoi le ciel est bleu</h2><p>La lumière du soleil contient toutes les couleurs, mais l’air disperse surtout le bleu.</p><p>Le soir, la lumière traverse plus d’air, et le rouge reste.</p></div></div><div class="q"><h4>Articles liés</h4><ul><li><a href="/p">La neige</a></li><li><a href="/v">Le vent</a></li></ul></div>'
        '<div class="w"><p>Inscrivez-vous à notre newsletter</p><form><input name="mail"><button>Envoyer</button></form></div></div><div class="b">Mentions légales</div></body></html>',
        ["Pourquoi le ciel est bleu", "La lumière du soleil contient toutes les couleurs, mais l’air disperse surtout le bleu.", "Le soir, la lumière traverse plus d’air, et le rouge reste."],
    ),
    (
        "<html><body><header><h1>The Owl Blog</h1><nav><a href=/>Home</a><a href=/x>Owls</a></nav></header><div><h2>Barn owls at night</h2><p>Barn owls hunt by ear, and their faces are shaped to catch the faintest sound.</p><pre>listen, turn, dive</pre><p>A pair with young catches a dozen mice in one night, sometimes more.</p></div>"
        "<div><h3>2 comments</h3><p>Tom says:</p><p>I saw one last week near the old mill, beautiful!</p><p>Reply</p><p>Guest says:</p><p>Great post, thanks.</p></div><footer>Powered by feathers</footer></body></html>",
        ["Barn owls at night", "Barn owls hunt by ear, and their faces are shaped to catch the faintest sound.", "listen, turn, dive", "A pair with young catches a dozen mice in one night, sometimes more."],
    ),
    (
        "<html><body><div class=a1>Sign up | Log in</div><div class=a2><h1>La fiesta del pueblo</h1><div>El pueblo celebra cada verano una fiesta con música, comida y fuegos en la plaza.</div><div>Este año llegan grupos de siete países, y los niños entran gratis.</div></div><div class=a3><a href=/1>Aviso legal</a> <a href=/2>Contacto</a></div></body></html>",
        ["La fiesta del pueblo", "El pueblo celebra cada verano una fiesta con música, comida y fuegos en la plaza.", "Este año llegan grupos de siete países, y los niños entran gratis."],
    ),
    ("<html><body><nav><a href=/>Home</a><a href=/b>Back to top</a></nav><footer>All rights reserved</footer></body></html>", []),
    (
        "<p>Just one paragraph of plain text on a page that has nothing else at all, which is the article.</p>",
        ["Just one paragraph of plain text on a page that has nothing else at all, which is the article."],
    ),
]
